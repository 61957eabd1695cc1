"""Runs of words that repeat with a period, by branching tandem repeats in an enhanced suffix array.

Words are the runs of `[^\\x20\\x09-\\x0D]+`. A run is a stretch of consecutive words of smallest period q
(words q apart are equal), at least `max(least, exponent * q)` words long, that no neighbouring word
extends keeping the period. Collapsing keeps the first q words of each run.

A task sorts the suffixes of some documents at a time (suffixes of different documents share nothing):
prefixes of 1, 2, 4, .. words are ranked until all differ, and the ranks of each length are kept. They
give the LCP array, and later compare two stretches of equal length at once. For each LCP value that
splits an interval of the suffix array, the suffixes i of the smaller part are tried: if suffix
i + depth or i - depth stands in the other part (known from the inverse array, ISA), two equal
neighbours of `depth` words start at the lesser of both, and the word after them breaks the repeat:
the last square of a run. It is rotated to the left as far as words stay equal, which gives the run.
Squares of a multiple of the period give the same stretch again; the smallest period stays. No tree
node is built, and only documents where enough consecutive words stand twice for any run are tried.

A task holds the words of one Arrow batch, and sorts about `block_words` of them, or one longer
document, at a time. Nothing is shuffled.

A null text has no words and no runs; a null id counts as the text ''. Empty tables give no rows.
Repeated rows are rows of their own, each with its runs. Other columns pass through; the new column
takes the place of one of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

RUN = "array<struct<start: long, length: long, period: long>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class SuffixOrder:
    """Suffixes of several word lists in order: sa, isa, lcp, and ranks of prefixes of 2**k words."""

    def __init__(self, docs: list[list[bytes]]):
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        self.n = n = int(lengths.sum())
        self.begins = np.cumsum(lengths) - lengths
        self.doc = np.repeat(np.arange(len(docs)), lengths)
        codes = pd.factorize(np.array([w for d in docs for w in d] + [b""], dtype=object))[0][:n]
        self.levels: list[np.ndarray] = []
        rank, where = self._ranked(np.zeros(n, dtype=np.int64), self.doc * np.int64(n + 1) + codes, np.arange(n))
        self._keep(rank)
        reach = 1
        while len(where):
            ahead = where + reach
            inside = ahead < n
            ahead[~inside] = 0
            inside &= self.doc[ahead] == self.doc[where]
            nxt = np.where(inside, rank[ahead] + 1, 0)
            rank, where = self._ranked(rank, rank[where] * np.int64(n + 2) + nxt, where)
            self._keep(rank)
            reach *= 2
        self.isa = self.levels[-1]
        self.sa = np.empty(n, dtype=np.int64)
        self.sa[rank] = np.arange(n)
        self.lcp = self._lcp()

    @staticmethod
    def _ranked(rank: np.ndarray, key: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ranks of the positions `where`, ordered by key, and those still equal to others. The rank of
        a group is the place of its first suffix; keys never put two groups of old ranks out of order."""
        order = np.argsort(key, kind="stable")
        at, key = where[order], key[order]
        old = rank[at]
        place = np.arange(len(at))
        first_old = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0)) if len(at) else place
        is_first = np.r_[True, key[1:] != key[:-1]] if len(at) else np.zeros(0, dtype=bool)
        first = np.maximum.accumulate(np.where(is_first, place, 0)) if len(at) else place
        rank = rank.copy()
        rank[at] = old + first - first_old
        alone = is_first & np.r_[is_first[1:], True] if len(at) else is_first
        return rank, at[~alone]

    def _keep(self, rank: np.ndarray) -> None:
        self.levels.append(np.r_[rank, -1].astype(np.int32))

    def _lcp(self) -> np.ndarray:
        """lcp[k]: words that the suffixes at k - 1 and k share."""
        a, b = self.sa[:-1].copy(), self.sa[1:].copy()
        shared = np.zeros(self.n, dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            equal = self.levels[k][a] == self.levels[k][b]
            step = equal * (1 << k)
            shared[1:] += step
            a += step
            b += step
        return shared

    def splits(self, shared: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(depth, left, middle, right): suffixes [left, middle) and [middle, right) share exactly `depth`
        words, at most `most`, for every boundary of an LCP interval of documents where `shared` words repeat."""
        deep = np.zeros(len(self.begins), dtype=np.int64)
        np.maximum.at(deep, self.doc[self.sa], self.lcp)
        tried = (self.lcp > 0) & (deep[self.doc[self.sa]] >= shared)
        places = np.flatnonzero(tried)
        values = self.lcp[places].tolist()
        left, right = [0] * len(values), [0] * len(values)
        stack: list[int] = []  # boundaries of rising depth
        before = -2
        for x, (place, v) in enumerate(zip(places.tolist(), values)):
            if place != before + 1:  # a boundary of depth 0 lies between
                for y in stack:
                    right[y] = before + 1
                stack.clear()
                base = place - 1
            before = place
            while stack and values[stack[-1]] > v:
                right[stack.pop()] = place
            left[x] = places[stack[-1]] if stack else base
            stack.append(x)
        for y in stack:
            right[y] = before + 1
        depth = np.array(values, dtype=np.int64)
        fit = depth <= most
        return depth[fit], np.array(left, dtype=np.int64)[fit], places[fit], np.array(right, dtype=np.int64)[fit]

    def last_squares(self, shared: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, depth) of the branching tandem repeats."""
        depth, left, middle, right = self.splits(shared, most)
        less = middle - left <= right - middle
        low, high = np.where(less, left, middle), np.where(less, middle, right)  # the smaller part
        low_o, high_o = np.where(less, middle, left), np.where(less, right, middle)
        starts, depths = [], []
        size = high - low
        ends = np.cumsum(size)
        cut = 0
        while cut < len(size):  # some millions of suffixes at a time
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + 4_000_000, side="right")))
            own = np.repeat(np.arange(cut, to), size[cut:to])
            within = np.arange(len(own)) - np.repeat(np.cumsum(size[cut:to]) - size[cut:to], size[cut:to])
            i, v = self.sa[low[own] + within], depth[own]
            for other, first in ((i + v, i), (i - v, i - v)):
                inside = (other >= 0) & (other <= self.n)
                at = self.isa[np.where(inside, other, self.n)]
                hit = (at >= low_o[own]) & (at < high_o[own])
                starts.append(first[hit])
                depths.append(v[hit])
            cut = to
        return (np.concatenate(starts), np.concatenate(depths)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of `length` (at least 1) words at a and b are equal."""
        k = np.log2(length).astype(np.int64)
        found = k < len(self.levels)
        for level in np.unique(k[found]):
            x = np.flatnonzero(k == level)
            rank, back = self.levels[level], length[x] - (1 << int(level))
            found[x] = (rank[a[x]] == rank[b[x]]) & (rank[a[x] + back] == rank[b[x] + back])
        return found


def runs_of(docs: list[list[bytes]], least: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Per word list: (start, length, period) of its runs, by start and then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    longest = max(map(len, docs), default=0)
    if longest < least:
        return found
    order = SuffixOrder(docs)
    shared = min(max(least, exponent * q) - q for q in range(1, least + 1))  # words that a run has twice at least
    start, period = order.last_squares(shared, longest // exponent)
    end, begin = start + 2 * period, order.begins[order.doc[start]]
    long = np.maximum(least, exponent * period)
    fit = end - long >= begin
    end, begin, period, long = end[fit], begin[fit], period[fit], long[fit]
    fit = order.equal(end - long, end - long + period, long - period)
    end, begin, period, long = end[fit], begin[fit], period[fit], long[fit]
    start = end - long
    for k in range(len(order.levels) - 1, -1, -1):  # rotation to the left, by 2**k words at once
        back = start - (1 << k)
        inside = back >= begin
        back[~inside] = 0
        same = inside & (order.levels[k][back] == order.levels[k][back + period])
        start = np.where(same, back, start)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, dtype=bool)
    for s, e, q in zip(start[new].tolist(), end[new].tolist(), period[new].tolist()):
        d = int(order.doc[s])
        found[d].append((s - int(order.begins[d]), e - s, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period, with blanks between."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _blocks(words: Iterator[list[bytes]], block_words: int) -> Iterator[list[list[bytes]]]:
    block, held = [], 0
    for w in words:
        if block and held + len(w) > block_words:
            yield block
            block, held = [], 0
        block.append(w)
        held += len(w)
    if block:
        yield block


def find_runs(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = 6,
    exponent: int = 4,
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
    block_words: int = 400_000,
    into: str = "runs",
) -> DataFrame:
    """`docs` with a struct `into`: n_words, found (start, length, period of each run, words from 0) and
    collapsed (the text without the repeats, its words joined by blanks). `least` must exceed 1 and
    `exponent` be 2 at least. `edit(id, words)`, if given, changes the words before they are searched."""
    if least < 2 or exponent < 2:
        raise ValueError("least and exponent must be 2 or more")

    plain = docs.drop(into) if into in docs.columns else docs
    added = T._parse_datatype_string(f"n_words long, found {RUN}, collapsed string")
    kind = to_arrow_type(added)

    def run(batches):
        for batch in batches:
            lists = map(words_of, batch.column(text).to_pylist())
            if edit is not None:
                lists = (edit(i, w) for i, w in zip(batch.column(doc_id).to_pylist(), lists))
            rows = []
            for block in _blocks(lists, block_words):
                for words, runs in zip(block, runs_of(block, least, exponent)):
                    found = [dict(zip(("start", "length", "period"), r)) for r in runs]
                    rows.append({"n_words": len(words), "found": found, "collapsed": collapse(words, runs)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, into])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(into, added)]))


def repeat_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents end in a repeated stretch; the others stay. The id decides
    both which, where it starts and how long the stretch is."""
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), and digests of
    all runs and of the collapsed text, after `repeat_tail`."""
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = find_runs(some, edit=repeat_tail, **options).select("doc_id", "runs.found", "runs.collapsed")
    best = F.array_max(F.transform("found", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("found", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("found").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.n") / -F.col("best.q")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Words q apart are equal over a stretch where its five-word pieces are: equal pieces of one document,
#: their distances, and consecutive places of one distance.
SQL = """
WITH c AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) AS h
  FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM c),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w
  FROM a),
p AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS t FROM d),
five AS (
  SELECT doc_id, n, i, concat_ws(' ', t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o) AS f
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.f = y.f AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
  WHERE y.i + 5 <= y.n),
isles AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM isles WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS turn FROM runs),
texts AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS r FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS k FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(x.n_runs, 0) AS n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period AS exponent_milli,
       sha256(coalesce(x.r, '')) AS runs_sha256, sha256(coalesce(k.k, '')) AS collapsed_sha256
FROM d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.turn = 1 LEFT JOIN texts x ON x.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
