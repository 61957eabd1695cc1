"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is
`window` consecutive words of a benchmark item; an item with fewer words, but not none, is one
window. Per window length there is one search: a block is two words, `shift` tells how far the
search may jump when a block ends at the current word, the blocks with shift 0 select the windows
that end with them, and a comparison of the words confirms each occurrence.

The benchmark goes to the tasks in blocks of about `block_words` words. One pass over the documents
searches blocks of about `search_words` words in all; a larger benchmark takes more passes, each of which
starts from the hits of those before. The search is the same at every size.

Nulls are texts without words. Items without words have no windows; an item with a null id still
marks words but is not named. Repeated documents are marked alike; repeated items count once. Empty
tables, of documents or items, give no rows or no hits. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import Stages

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = "n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WindowSearch:
    """All windows of one length: shift table, suffix buckets, search."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.longest = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict[object, dict[tuple, set]] = {}

    def add(self, window: tuple, item: str | None) -> None:
        b = self.block
        for end in range(b, self.length + 1):
            block = window[end - b : end]
            jump = self.length - end
            if jump < self.shift.get(block, self.longest):
                self.shift[block] = jump
        owners = self.buckets.setdefault(window[self.length - b :], {}).setdefault(window, set())
        if item is not None:
            owners.add(item)

    def find(self, words: list[bytes]):
        """Yields (start, owners) of every occurrence."""
        m, n, shift, longest = self.length, len(words), self.shift, self.longest
        i = m
        if self.block == 2:
            while i <= n:
                jump = shift.get((words[i - 2], words[i - 1]), longest)
                if jump:
                    i += jump
                    continue
                window = tuple(words[i - m : i])
                owners = self.buckets[window[-2:]].get(window)
                if owners is not None:
                    yield i - m, owners
                i += 1
        else:
            for at, word in enumerate(words):
                if (word,) in self.shift:
                    yield at, self.buckets[(word,)][(word,)]


def build_search(items: list[tuple[str | None, list[bytes]]], window: int) -> list[WindowSearch]:
    by_length: dict[int, WindowSearch] = {}
    for item, words in items:
        m = min(window, len(words))
        if m:
            search = by_length.setdefault(m, WindowSearch(m))
            for start in range(len(words) - m + 1):
                search.add(tuple(words[start : start + m]), item)
    return list(by_length.values())


def find_windows(words: list[bytes], searches: list[WindowSearch]):
    """Merged [start, end) word spans that windows cover, and the items they belong to."""
    spans, items = [], set()
    for search in searches:
        for start, owners in search.find(words):
            spans.append((start, start + search.length))
            items |= owners
    return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def item_blocks(items: DataFrame, block_words: int):
    """Items (i, t) in blocks of about `block_words` words, one block in the driver at a time. The
    frame is a written table: what is read must be what was counted, or this raises."""
    block, held, seen, expected = [], 0, 0, items.count()
    for row in items.toLocalIterator():
        words = words_of(row.t)
        block.append((row.i, words))
        held += len(words)
        seen += 1
        if held >= block_words:
            yield block
            block, held = [], 0
    if seen != expected:
        raise RuntimeError(f"{seen} of {expected} benchmark items were read")
    if block:
        yield block


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_words: int = 250_000,
    search_words: int = 2_000_000,
    into: str = "hits",
) -> DataFrame:
    """`docs` with a struct column `into`: n_words, starts and ends of the hit word spans, items.

    Blocks of `block_words` words bound a broadcast, `search_words` the words that a task holds at
    once. Between passes the documents with their hits so far are written; nothing is shuffled.
    """
    stages = Stages(docs.sparkSession)
    items = stages.write(benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).distinct())
    none = F.lit(None).cast(f"struct<{_as_fields()}>")
    marked, held, blocks, written = docs.withColumn(into, none), 0, [], None
    for block in item_blocks(items, block_words):
        if blocks and held + block_words > search_words:
            before, written = written, stages.write(marked)
            marked, held = written, 0
            if before is not None:
                stages.drop(before)
            for sent in blocks:
                sent.unpersist()
            blocks = []
        blocks.append(docs.sparkSession.sparkContext.broadcast(block))
        held += block_words
        marked = marked.withColumn(into, _search_udf(blocks[-1], window)(F.col(text), F.col(into)))
    if not blocks:
        marked = marked.withColumn(into, _search_udf(docs.sparkSession.sparkContext.broadcast([]), window)(F.col(text), F.col(into)))
    stages.drop(items)
    return marked


def _as_fields() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in RESULT.split(", ")))


def _search_udf(block, window: int):
    held: dict = {}

    @pandas_udf(RESULT)
    def search(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        if "s" not in held:
            held["s"] = build_search(block.value, window)
        rows = []
        for text, n, starts, ends, items in zip(texts, before["n_words"], before["starts"], before["ends"], before["items"]):
            words = words_of(text)
            spans, named = find_windows(words, held["s"])
            if starts is not None and len(starts):
                spans = merge_spans([*spans, *zip(map(int, starts), map(int, ends))])
            if items is not None:
                named = named | set(items)
            rows.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(named)))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"], dtype=object)

    return search


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark_contaminated(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    n_hit = F.aggregate(F.zip_with("hits.ends", "hits.starts", lambda e, s: e - s), F.lit(0), lambda a, x: a + x).cast("long")
    return marked.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bw AS (SELECT item_id, w, len(w) AS n, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT item_id, w, m, unnest(range(1, n - m + 2)) AS s FROM bw)),
dw AS (
  SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
        FROM d, (SELECT DISTINCT m FROM bw) AS ms WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.s, dw.m, wins.item_id FROM dw JOIN wins ON dw.m = wins.m AND dw.win = wins.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit,
       coalesce(its.n_items, 0) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
