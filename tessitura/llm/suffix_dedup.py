"""Exact substring deduplication over all texts: suffix order and longest previous factors.

Texts are UTF-8 bytes. A byte is removed if a string of `length` bytes that covers it also starts
elsewhere, in the same document or another (`keep="none"`), or started earlier (`keep="first"`:
in the order of doc_id, then position; the first copy stays).

The suffixes of a corpus do not fit one sort, so they are sharded such that equal strings meet.
The anchor of a string of `length` bytes is its k-gram of least hash, the leftmost of equals; equal
strings have equal anchors. The starts with the same anchor are a run, and the bytes that the
strings from a run cover are its context. Runs whose anchor hash occurs once are done. Runs with
equal contexts have equal suffixes throughout, so they are one place in suffix order: their first is
sorted for all of them, and the others have it as an earlier match of their whole length. The contexts
of an anchor go into one suffix array, built by prefix doubling up to `length` bytes. The positions
before and after each suffix in that order that are smaller than its own, with the common prefixes on
the way, give its longest previous factor (LPF); the same with greater positions its longest next
factor. Both are computed up to `length`. A string has an earlier match if its LPF is `length`, and a
later one if its longest next factor is.

An anchor with more than `split` different contexts is split, so that no task holds them all: each of
its strings goes by the 64-bit hash of its bytes to a shard of its own, where only equal strings meet.
In such a shard every LPF is `length`, but for the first string's, so it is counted and not sorted.

Nulls are empty texts; texts shorter than `length` lose nothing. Repeated rows are documents of
their own and copies of each other. The order of documents is that of their ids, null first; ids that are no
whole numbers are ordered by a hash. Other columns take no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, Stages, sized_broadcast
from .decontaminate import merge_spans
from .jaccard_join import mix

GRAM = 32
#: Bytes that are worked on at a time.
BLOCK = 1 << 20
_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling."""
    x, span = _BYTE[data], 1
    while span < GRAM:
        x = x[:-span] * _U(0x5851F42D4C957F2D + 2 * span) + x[span:]
        span *= 2
    return mix(x)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value among `width` values from each place."""
    best, at, span = values, np.arange(len(values), dtype=np.int64), 1
    while span < width:
        step = min(span, width - span)
        right = best[step:] < best[:-step]
        best = np.where(right, best[step:], best[:-step])
        at = np.where(right, at[step:], at[:-step])
        span += step
    return at


def anchor_runs(texts: list[bytes], length: int):
    """Runs of starts with one anchor: arrays text, start, count, anchor hash, context digest."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = b"".join(texts)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    ends = np.cumsum(sizes)
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    anchors = leftmost_minima(hashes, length - GRAM + 1)
    starts = np.arange(len(anchors), dtype=np.int64)
    starts = starts[starts + length <= np.repeat(ends, sizes)[: len(anchors)]]
    if not len(starts):
        return empty, empty, empty, empty, empty
    at = anchors[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    text = np.searchsorted(ends, begin, side="right")
    view = memoryview(data)
    digest = np.array([xxhash.xxh3_64_intdigest(view[b : b + c + length - 1]) for b, c in zip(begin.tolist(), count.tolist())], _U)
    return text, begin - (ends - sizes)[text], count, hashes[at[first]].view(np.int64), digest.view(np.int64)


def _blocks(texts: list[bytes]):
    """Index ranges of texts with about BLOCK bytes; a longer text is a block of its own."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BLOCK:
            yield low, i
            low, held = i, 0
        held += len(t)
    if texts:
        yield low, len(texts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def document_runs(docs: DataFrame, length: int) -> DataFrame:
    """(h, g, rid, doc_id, start, n): the runs of all documents with columns rid, doc_id, text."""

    def run(batches):
        for batch in batches:
            texts = _bytes(batch.column("text"))
            rid = np.asarray(batch.column("rid"))
            key = np.asarray(batch.column("doc_key"))
            for low, high in _blocks(texts):
                text, start, count, h, g = anchor_runs(texts[low:high], length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h, g, rid[low:high][text], key[low:high][text], start, count)], ["h", "g", "rid", "doc_key", "start", "n"]
                )

    return docs.select("rid", "doc_key", "text").mapInArrow(run, "h long, g long, rid long, doc_key long, start long, n long")


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(span, rank of each place by its first `span` bytes), up to `length`, by prefix doubling; missing bytes are zeros."""

    def rank(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        steps = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        out = np.empty(len(keys), np.int64)
        out[order] = steps
        return out

    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    keys = np.zeros(n, _U)
    for j in range(8):
        keys = (keys << _U(8)) | padded[j : j + n]
    ranks, span = rank(keys), 8
    levels = [(span, ranks)]
    while span < length:
        step = min(span, length - span)
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = ranks[step:] + 1
        ranks = rank(ranks * (n + 2) + later)
        span += step
        levels.append((span, ranks))
    return levels


def common_prefixes(data: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of the places a[i] and b[i], up to `length`; both have so many bytes."""
    found = np.where(levels[-1][1][a] == levels[-1][1][b], length, 0)
    live = np.flatnonzero(found == 0)
    a, b, got = a[live], b[live], np.zeros(len(live), np.int64)
    for span, ranks in reversed(levels[:-1]):
        got += span * (ranks[a + got] == ranks[b + got])
    for _ in range(7):
        got += (got < length) & (data[np.minimum(a + got, len(data) - 1)] == data[np.minimum(b + got, len(data) - 1)])
    found[live] = np.minimum(got, length - 1)
    return found


def nearest_smaller(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Per place in suffix order the common prefix with the nearest one before it that has a smaller
    position; 0 without one. `shared` are the common prefixes with the place before.

    All places jump at once: what lies between a place and the one it points to has greater positions,
    so where that one is greater too, its own pointer is the next to try.
    """
    to, prefix = np.arange(-1, len(position) - 1), shared.copy()
    prefix[:1] = 0
    live = np.flatnonzero(to >= 0)
    while len(live):
        live = live[position[to[live]] > position[live]]
        prefix[live] = np.minimum(prefix[live], prefix[to[live]])
        to[live] = to[to[live]]
        prefix[live[to[live] < 0]] = 0
        live = live[to[live] >= 0]
    return prefix


def longest_factors(position: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factors, by place in suffix order, from positions in the text and common prefixes."""
    back = np.concatenate([[0], shared[1:][::-1]])[: len(shared)]

    def both(p: np.ndarray) -> np.ndarray:
        return np.maximum(nearest_smaller(p, shared), nearest_smaller(p[::-1], back)[::-1])

    return both(position), both(-position)


def matched_starts(contexts: list[bytes], counts: list[int], places: list[tuple], length: int):
    """Per context two masks over its starts: whether the string there has an earlier and a later match.

    `counts` are the numbers of starts; `places` orders the contexts' first starts, as sortable tuples
    whose last item is a position.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    levels = prefix_ranks(data, length)
    ranks = levels[-1][1]
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])[:-1]])
    where = np.concatenate([np.arange(b, b + n) for b, n in zip(base, counts)])
    order = sorted(range(len(contexts)), key=lambda i: places[i])
    turn = np.empty(len(contexts), np.int64)
    turn[order] = np.arange(len(contexts))
    text_order = np.repeat(turn, counts) * (max(counts) + 1) + np.concatenate([np.arange(n) for n in counts])
    suffix_order = np.lexsort((text_order, ranks[where]))
    place = where[suffix_order]
    shared = np.concatenate([[0], common_prefixes(data, levels, place[:-1], place[1:], length)])
    previous, following = longest_factors(text_order[suffix_order], shared)
    earlier, later = np.zeros(len(where), bool), np.zeros(len(where), bool)
    earlier[suffix_order] = previous >= length
    later[suffix_order] = following >= length
    cuts = np.cumsum(counts)[:-1]
    return np.split(earlier, cuts), np.split(later, cuts)


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def suffix_matches(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans (rid, doc_key, low, high) by the suffix arrays of the contexts, which come grouped by h."""

    def solve(rows):
        earlier, later = matched_starts([r[4] for r in rows], [r[5] for r in rows], [(r[1], r[2], r[3]) for r in rows], length)
        out = []
        for row, e, s in zip(rows, earlier, later):
            if row[6] == 1 or keep_first:
                out += [(row[2], row[1], row[3] + a, row[3] + b - 1 + length) for a, b in _ranges(e if keep_first else e | s)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["rid", "doc_key", "low", "high"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "doc_key", "rid", "start", "context", "n", "copies")]
            for row in zip(*columns):
                if held > BLOCK and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield solve(rows)

    return contexts.select("h", "doc_key", "rid", "start", "context", "n", "copies").mapInArrow(run, "rid long, doc_key long, low long, high long")


def string_hashes(contexts: DataFrame, length: int) -> DataFrame:
    """(h, f, rid, doc_key, at): every string of the contexts of split anchors by its hash."""

    def run(batches):
        for batch in batches:
            for h, key, rid, start, context, n in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_key", "rid", "start", "context", "n"))):
                view = memoryview(context)
                f = np.array([xxhash.xxh3_64_intdigest(view[i : i + length]) for i in range(n)], _U).view(np.int64)
                same = [pa.array(np.full(n, v, np.int64)) for v in (h, rid, key)]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(f), same[1], same[2], pa.array(start + np.arange(n))], ["h", "f", "rid", "doc_key", "at"])

    return contexts.select("h", "doc_key", "rid", "start", "context", "n").mapInArrow(run, "h long, f long, rid long, doc_key long, at long")


def cut_spans(docs: DataFrame, length: int) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256, kept of documents with columns text and spans."""

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                merged = merge_spans([(s["low"], s["high"]) for s in spans or ()])
                edges = [0, *(x for span in merged for x in span), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(t), len(t) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_spans(rows: DataFrame, stages: Stages, length: int, keep_first: bool, split: int) -> DataFrame:
    """Spans (rid, doc_key, low, high) to remove; they may overlap."""
    runs = stages.write(document_runs(rows, length))
    shared = stages.write(runs.groupBy("h").agg(F.count("*").alias("c"), F.min("g").alias("a"), F.max("g").alias("b")).where("c > 1"))
    found = stages.write(runs.join(shared.select("h", (F.col("a") < F.col("b")).alias("differ")), "h"))
    stages.drop(shared, runs)
    contexts = stages.write(
        found.groupBy("h", "g", "differ").agg(F.count("*").alias("copies"), F.min(F.struct("doc_key", "rid", "start", "n")).alias("first"))
    )
    copied = contexts.where("copies > 1").select("h", "g", "first")
    whole = found.join(copied, ["h", "g"])
    if keep_first:
        whole = whole.where((F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start")))
    whole = whole.select("rid", "doc_key", F.col("start").alias("low"), (F.col("start") + F.col("n") - 1 + length).alias("high"))

    many = contexts.where("differ").groupBy("h").agg(F.count("*").alias("contexts"))
    refs = contexts.where("differ").join(many, "h").select("h", "copies", (F.col("contexts") > split).alias("split"), "first.*")
    per_doc = stages.write(refs.groupBy("rid", "doc_key").agg(F.collect_list(F.struct("h", "copies", "split", "start", "n")).alias("refs")))
    texts = rows.select("rid", "doc_key", "text").join(sized_broadcast(per_doc.select("rid", "doc_key")), ["rid", "doc_key"], "left_semi").dropDuplicates(["rid", "doc_key"])
    slices = texts.join(per_doc, ["rid", "doc_key"]).select("rid", "doc_key", F.col("text").cast("binary").alias("data"), F.explode("refs").alias("r")).select(
        "rid", "doc_key", "r.*", F.substring("data", F.col("r.start").cast("int") + 1, (F.col("r.n") - 1 + length).cast("int")).alias("context")
    )
    slices = stages.write(slices)
    parts = slices.where("not split").repartition("h").sortWithinPartitions("h")
    ends = stages.write(suffix_matches(parts, length, keep_first))

    strings = string_hashes(slices.where("split"), length)
    equal = strings.groupBy("h", "f").agg(F.count("*").alias("c"), F.min(F.struct("doc_key", "rid", "at")).alias("first")).where("c > 1")
    hot = strings.join(equal, ["h", "f"])
    if keep_first:
        hot = hot.where((F.col("rid") != F.col("first.rid")) | (F.col("at") != F.col("first.at")))
    hot = stages.write(hot.select("rid", "doc_key", F.col("at").alias("low"), (F.col("at") + length).alias("high")))
    spans = stages.write(whole.unionByName(ends).unionByName(hot).distinct())
    stages.drop(found, contexts, per_doc, slices, ends, hot)
    return spans


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 200, keep: str = "first", split: int = 4096
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    if keep not in ("first", "none") or length <= GRAM:
        raise ValueError(f"keep is 'first' or 'none', and length is over {GRAM}")
    stages = Stages(docs.sparkSession)
    whole_numbers = docs.select(F.col(doc_id)).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    order = F.col(doc_id).cast("long") if whole_numbers else F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.lit("order"), doc_id))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(order, F.lit(-(2**63))).alias("doc_key"),
        F.xxhash64(doc_id, text).alias("rid"),
    )
    spans = repeated_spans(rows, stages, length, keep == "first", split)
    per_doc = stages.write(spans.groupBy("rid", "doc_key").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    stages.drop(spans)
    n, both = per_doc.count(), ["rid", "doc_key"]
    if n > BROADCAST_ROWS:
        return cut_spans(rows.join(per_doc, both, "left"), length)
    ids = F.broadcast(per_doc.select(both))
    whole = rows.join(ids, both, "left_anti").withColumn("spans", F.expr("cast(null as array<struct<low: bigint, high: bigint>>)"))
    cut = rows.join(ids, both, "left_semi").join(per_doc, both)
    return cut_spans(whole.select("doc_id", "text", "spans"), length).unionByName(cut_spans(cut.select("doc_id", "text", "spans"), length))


SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (
  SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS f
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS s FROM d WHERE length(x) >= 400)),
r AS (SELECT f FROM p GROUP BY f HAVING count(*) > 1),
m AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS q FROM p SEMI JOIN r ON p.f = r.f),
g AS (SELECT doc_id, s, sum(CASE WHEN q IS NULL OR s > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM m),
runs AS (SELECT doc_id, k, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY doc_id, k),
cuts AS (
  SELECT d.doc_id, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY k), 0) AS low, a AS high, k, b - a AS cut, x
  FROM runs JOIN d ON runs.doc_id = d.doc_id),
tails AS (SELECT doc_id, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
heads AS (SELECT doc_id, string_agg(substr(x, 2 * low + 1, 2 * (high - low)), '' ORDER BY k) AS y FROM cuts GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(y, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN tails ON d.doc_id = tails.doc_id LEFT JOIN heads ON d.doc_id = heads.doc_id
"""
