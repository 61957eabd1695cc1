"""Alignment of two tokenizers' tokens by whitespace-token anchors.

A is a byte-level BPE (a `tokenizers` file), B a byte-fallback sentencepiece model; neither is trained or
changed here. A text gets a leading space, as B adds one, and both encode it whole, without special
tokens (their strings in a text are plain text). Token bytes, joined, must give the space and the text.

An anchor is a byte offset where a token of each side ends and the next of each side starts with a space.
Anchors cut a document into windows of token ids; a window's alignment depends on its ids only, so equal windows
of a piece of the input are found first, and what one of them gives is kept under its two tuples of ids
for the rest of the task (at most `memo` of them at a time; windows of over `memo_ids` ids, where words
have no spaces, are not kept). The tuples stand in columns, sorted by a hash, and are compared whole. Offsets where both sides end cut
a window into groups; each pair of an A and a B token whose bytes overlap is a link.

Counts over the corpus (`pair_counts`): in how many documents a pair of ids is linked, from the distinct
pairs of each document, summed map-side first; their number is bounded by the vocabularies, not the
corpus. They come back to the documents by a broadcast if their counted size allows, else by a shuffle in
which the pairs of over a thousandth of the rows, hence at most a thousand, are broadcast instead.

Texts that are null, empty or not rendered exactly by either side have no tokens: zeros and ''. A null id
is an id like others, repeated rows count as documents of their own, and an empty table gives no rows.
Other columns pass through; the new column takes the place of one of the same name.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import BROADCAST_ROWS, Stages

FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.json"
PIECE_BPE = f"{FOLDER}/piece_bpe_32k.model"

#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A pair of ids as one number.
SHIFT = 1 << 31

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, groups string"


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 signs are
    themselves, the others follow from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Flat:
    """Byte strings one after the other."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.array([len(s) for s in strings], dtype=np.int64)
        self.begins = np.cumsum(self.length) - self.length

    def spell(self, numbers: np.ndarray) -> np.ndarray:
        return _gathered(self.data, self.begins[numbers], self.length[numbers])


class Tokens:
    """One side: encoding, and bytes, length and space mark of each id."""

    def __init__(self, encode, rendered: list[bytes]):
        self.encode = encode
        self.bytes = rendered
        self.flat = Flat(rendered)
        self.length = self.flat.length
        self.marked = np.array([b[:1] == b" " for b in rendered], dtype=bool)

    def spell(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_level(file: bytes, merge_ranks: bool = True) -> Tokens:
    """The byte-level BPE of a `tokenizers` file. Where its merges stand in the order of their ids and nothing
    else but the usual split is set, ids are the ranks that `tiktoken` takes, which gives the same tokens
    in a third of the time; else, or without `merge_ranks`, `tokenizers` encodes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_buffer(file)
    own.encode_special_tokens = True
    of_sign, rendered = byte_of_sign(), [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        rendered[i] = bytes(of_sign[c] for c in token) if all(c in of_sign for c in token) else token.encode()
    told = json.loads(file)
    ids, split = told["model"]["vocab"], told["pre_tokenizer"] or {}
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if merge_ranks and usual and told.get("normalizer") is None and merged == sorted(merged) and not told["model"].get("ignore_merges"):
        from tiktoken import Encoding

        special = {t["id"] for t in told["added_tokens"]}
        ranks = {rendered[i]: i for i in ids.values() if i not in special}
        same = Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return Tokens(lambda texts: [same.encode_ordinary(" " + t) for t in texts], rendered)
    return Tokens(lambda texts: [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], rendered)


@lru_cache(maxsize=2)
def byte_fallback(file: bytes) -> Tokens:
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_proto=file)
    return Tokens(lambda texts: own.encode(texts, num_threads=1), [piece_bytes(own.id_to_piece(i)) for i in range(own.get_piece_size())])


class Windows:
    """Windows that are remembered, by their ids, with what was found for each; all in columns."""

    def __init__(self):
        self.keys, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by key
        self.ids, self.begins, self.sizes = ([np.zeros(0, np.int64)] * 2 for _ in range(3))
        self.names: list[str] = []
        self.links, self.link_begins, self.link_sizes = (np.zeros(0, np.int64) for _ in range(3))

    def find(self, keys: np.ndarray, sides: list[tuple]) -> np.ndarray:
        """The entry of each window (ids, begins, sizes on both sides), or -1; all ids are compared."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        entry = self.entries[at] if len(self.keys) else np.full(len(keys), -1)
        met = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.zeros(0, np.int64)
        for (ids, begins, sizes), own_ids, own_begins, own_sizes in zip(sides, self.ids, self.begins, self.sizes):
            met = met[sizes[met] == own_sizes[entry[met]]]
            met = met[_equal(ids, begins[met], own_ids, own_begins[entry[met]], sizes[met])]
        found = np.full(len(keys), -1)
        found[met] = entry[met]
        return found

    def add(self, keys: np.ndarray, sides: list[tuple], names: list[str], links: np.ndarray, link_sizes: np.ndarray) -> None:
        """Windows with new keys, sorted by these; their ids and links stand one after the other."""
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.entries = np.insert(self.entries, place, np.arange(len(self.names), len(self.names) + len(names)))
        self.begins = [np.r_[begins, len(held) + np.cumsum(sizes) - sizes] for begins, held, (_, sizes) in zip(self.begins, self.ids, sides)]
        self.sizes = [np.r_[held, sizes] for held, (_, sizes) in zip(self.sizes, sides)]
        self.ids = [np.r_[held, ids] for held, (ids, _) in zip(self.ids, sides)]
        self.names += names
        self.link_begins = np.r_[self.link_begins, len(self.links) + np.cumsum(link_sizes) - link_sizes]
        self.link_sizes, self.links = np.r_[self.link_sizes, link_sizes], np.r_[self.links, links]


class Aligner:
    """Aligns documents of two sides, with a memory of windows."""

    def __init__(self, a: Tokens, b: Tokens, memo: int = 200_000, memo_ids: int = 48):
        self.a, self.b, self.memo, self.memo_ids = a, b, memo, memo_ids
        self.known = Windows()
        # ids as text, each with the sign that follows it: of A inside a group and at its end, of B likewise
        names = [f"{i}{sign}".encode() for side, signs in ((a, ",|"), (b, ",;")) for sign in signs for i in range(len(side.bytes))]
        self.name_begins = np.cumsum([0, len(a.bytes), len(a.bytes), len(b.bytes)])
        self.names = Flat(names)
        rng = np.random.default_rng(13)
        self.mixed = [rng.integers(0, 1 << 63, len(side.bytes), dtype=np.uint64) | np.uint64(1) for side in (a, b)]

    def aligned(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups as text, id pairs of the links and number of links of windows one after the other, whose two
        lists of ids spell the same bytes: all offsets of all windows at once."""
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        ends = np.sort(np.r_[ends_a, ends_b], kind="stable")
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]]  # up to each of these, from the one before, lies one token of each side
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = a[at_a] * SHIFT + b[at_b]
        shared = ends[(ends_a[at_a] == ends) & (ends_b[at_b] == ends)]
        # tokens in the order of the text: by group, those of A first; each is followed by a sign
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = (np.r_[g[1:] != g[:-1], True] for g in (group_a, group_b))
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        name = np.r_[self.name_begins[np.where(last_a, 1, 0)] + a, self.name_begins[np.where(last_b, 3, 2)] + b][order]
        text = self.names.spell(name).tobytes().decode("ascii")
        cuts = np.cumsum(self.names.length[name])[np.cumsum(sizes_a + sizes_b) - 1].tolist()
        last_links = np.searchsorted(ends, ends_a[np.cumsum(sizes_a) - 1], side="right")
        return [text[x : y - 1] for x, y in zip([0, *cuts], cuts)], links, np.diff(last_links, prepend=0)

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First A and B token of each window. The sides spell the same bytes, that is documents one after
        the other; each of these begins with a space, hence with a window."""
        at_a, at_b = np.flatnonzero(self.a.marked[a[1:]]), np.flatnonzero(self.b.marked[b[1:]])
        ends_a, ends_b = np.cumsum(self.a.length[a])[at_a], np.cumsum(self.b.length[b])[at_b]
        place = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(place < len(ends_b))
        shared = shared[ends_b[place[shared]] == ends_a[shared]]
        return np.r_[0, at_a[shared] + 1], np.r_[0, at_b[place[shared]] + 1]

    def looked_up(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Groups as text, id pairs of the links and number of links of the different windows, and the number
        of each window's among them. Windows are sorted by a hash of their ids; all ids of those with
        equal hashes are compared."""
        size_a, size_b = np.diff(from_a, append=len(a)), np.diff(from_b, append=len(b))
        key = _hashes(a, from_a, size_a, self.mixed[0]) * np.uint64(0x9E3779B97F4A7C15) + _hashes(b, from_b, size_b, self.mixed[1])
        keys, first, own = np.unique(key, return_index=True, return_inverse=True)
        same = first[own]
        equal = np.flatnonzero((size_a == size_a[same]) & (size_b == size_b[same]))
        for ids, begins, sizes in ((a, from_a, size_a), (b, from_b, size_b)):
            equal = equal[_equal(ids, begins[equal], ids, begins[same[equal]], sizes[equal])]
        if len(equal) < len(own):  # windows that only share a hash stand for themselves
            other = np.setdiff1d(np.arange(len(own)), equal)
            own[other] = len(first) + np.arange(len(other))
            first = np.r_[first, other]
        sides = [(a, from_a[first], size_a[first]), (b, from_b[first], size_b[first])]
        entry = self.known.find(key[first], sides)
        hit, miss = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        names, sizes = [""] * len(first), np.zeros(len(first), np.int64)
        for k, e in zip(hit.tolist(), entry[hit].tolist()):
            names[k] = self.known.names[e]
        sizes[hit] = self.known.link_sizes[entry[hit]]
        links, begins = _gathered(self.known.links, self.known.link_begins[entry[hit]], sizes[hit]), np.zeros(len(first), np.int64)
        begins[hit] = np.cumsum(sizes[hit]) - sizes[hit]
        if len(miss):
            new = [(_gathered(ids, begin[miss], size[miss]), size[miss]) for ids, begin, size in sides]
            made, new_links, new_sizes = self.aligned(new[0][0], new[1][0], new[0][1], new[1][1])
            for k, name in zip(miss.tolist(), made):
                names[k] = name
            sizes[miss], begins[miss] = new_sizes, len(links) + np.cumsum(new_sizes) - new_sizes
            links = np.r_[links, new_links]
            self.remember(keys, miss, sides, names, links, begins, sizes)
        return names, _gathered(links, begins, sizes), sizes, own

    def remember(self, keys: np.ndarray, miss: np.ndarray, sides: list[tuple], names: list[str], links: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps new windows, the first of each hash, up to `memo` of them in all; before more, all are forgotten."""
        new = miss[(miss < len(keys)) & (sides[0][2][miss] + sides[1][2][miss] <= self.memo_ids)]
        if len(self.known.names) + len(new) > self.memo:
            self.known = Windows()
        new = new[: self.memo]
        if len(self.known.keys):
            at = np.minimum(np.searchsorted(self.known.keys, keys[new]), len(self.known.keys) - 1)
            new = new[self.known.keys[at] != keys[new]]
        if len(new):
            held = [(_gathered(ids, begin[new], size[new]), size[new]) for ids, begin, size in sides]
            self.known.add(keys[new], held, [names[k] for k in new.tolist()], _gathered(links, begins[new], sizes[new]), sizes[new])

    def documents(self, texts: list[str | None], groups: bool):
        """One row of ALIGNED for each text."""
        given = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in given]
        rows: list[tuple] = [(0, 0, 0, 0, "", [], [], "" if groups else None)] * len(texts)
        given, (a, b), (n_a, n_b) = self.spelled(given, some, self.a.encode(some), self.b.encode(some))
        if not given:
            return rows
        from_a, from_b = self.windows(a, b)
        names, flat, sizes, own = self.looked_up(a, b, from_a, from_b)
        per_window = sizes[own]
        links = _gathered(flat, (np.cumsum(sizes) - sizes)[own], per_window)
        ends, numbers = np.cumsum(per_window), own.tolist()
        last = np.searchsorted(from_a, np.cumsum(n_a))  # windows up to the end of each document
        before, seen = 0, 0
        for i, own_a, own_b, w in zip(given, n_a.tolist(), n_b.tolist(), last.tolist()):
            here = links[seen : (seen := int(ends[w - 1]))]
            pairs, times = np.unique(here, return_counts=True)
            text = ";".join([names[k] for k in numbers[before:w]])
            before = w
            # each offset where a token of either side ends closes one link, and a group if both end there
            n = own_a + own_b - len(here)
            rows[i] = (own_a, own_b, n, len(here), hashlib.sha256(text.encode()).hexdigest(), pairs, times, text if groups else None)
        return rows

    def spelled(self, numbers: list[int], texts: list[str], all_a: list[list[int]], all_b: list[list[int]]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Of the texts that both sides spell with their leading space: numbers, ids of each side one after the
        other, and how many a text has."""
        counts = [np.fromiter(map(len, x), np.int64, len(x)) for x in (all_a, all_b)]
        ids = [np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip((all_a, all_b), counts)]
        lines = [b" " + t.encode() for t in texts]

        def keep(right):
            nonlocal numbers, lines, counts, ids
            if not right.all():
                ids = [x[np.repeat(right, n)] for x, n in zip(ids, counts)]
                counts = [n[right] for n in counts]
                numbers, lines = ([x for x, r in zip(all_x, right.tolist()) if r] for all_x in (numbers, lines))

        for k, side in enumerate((self.a, self.b)):
            ends = np.r_[0, np.cumsum(side.length[ids[k]])]
            keep(np.diff(ends[np.r_[0, np.cumsum(counts[k])]]) == [len(x) for x in lines])
        for k, side in enumerate((self.a, self.b)):
            if lines:
                differ = side.flat.spell(ids[k]) != np.frombuffer(b"".join(lines), np.uint8)
                sizes = np.array([len(x) for x in lines])
                keep(~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes))
        return numbers, ids, counts


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the sizes in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of values, one after the other."""
    return values[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


def _hashes(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.full(int(sizes.max()), 0xD1342543DE82EF95, dtype=np.uint64))
    return np.add.reduceat(mixed[ids] * powers[_within(sizes)], begins) + sizes.astype(np.uint64)


def _equal(ids: np.ndarray, begins: np.ndarray, other_ids: np.ndarray, other_begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether stretches of ids have the ids of others as long, none of them empty."""
    if not len(sizes):
        return np.zeros(0, bool)
    differ = _gathered(ids, begins, sizes) != _gathered(other_ids, other_begins, sizes)
    return ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)


def align_tokens(docs: DataFrame, *, text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, memo: int = 200_000, memo_ids: int = 48, groups: bool = False, chunk: int = 1_000_000, into: str = "tokens") -> DataFrame:
    """`docs` with a struct `into`: n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct linked id
    pairs, A id * 2^31 + B id), times (links of each) and, if asked for, groups as text
    (`a1,a2|b1;a3|b2,b3`). The two files are read by the driver and sent to the tasks; a task encodes
    about `chunk` characters, or one longer text, at a time."""
    files = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as f:
            files.append(f.read())
    sent = docs.sparkSession.sparkContext.broadcast(tuple(files))

    def chunks(texts):
        some, held = [], 0
        for t in texts:
            some.append(t)
            held += len(t) if t else 0
            if held >= chunk:
                yield some
                some, held = [], 0
        yield some

    plain = docs.drop(into) if into in docs.columns else docs
    added = T._parse_datatype_string(ALIGNED)
    kinds = to_arrow_type(added)

    def run(batches):
        aligner = Aligner(byte_level(sent.value[0]), byte_fallback(sent.value[1]), memo, memo_ids)
        gc.disable()  # the memory holds no cycles, only very many objects
        try:
            for batch in batches:
                rows = [row for some in chunks(batch.column(text).to_pylist()) for row in aligner.documents(some, groups)]
                columns = [_column(values, kind.type) for values, kind in zip(zip(*rows), kinds)]
                made = pa.StructArray.from_arrays(columns, fields=list(kinds)) if rows else pa.array([], kinds)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])
        finally:
            gc.enable()

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(into, added)]))


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)])
    inner = np.concatenate([np.asarray(v, dtype=np.int64) for v in values])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inner, kind.value_type))


def pair_counts(aligned: DataFrame, into: str = "tokens") -> DataFrame:
    """(pair, count, best) over the documents of `align_tokens`: how many hold the pair, and whether no
    pair of the same A id is held by more."""
    counts = aligned.select(F.explode(f"{into}.pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    of_a = F.expr(f"pair div {SHIFT}")
    most = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", of_a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. The aligned
    documents are written once: tokens are made once. `broadcast_rows` bounds a broadcast count table."""
    stages = Stages(docs.sparkSession)
    some = align_tokens(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **options).drop("text")
    aligned = stages.write(some.withColumn("row", F.monotonically_increasing_id()))
    counts = stages.write(pair_counts(aligned))
    n_counts, total = counts.agg(F.count("*"), F.sum("count")).first()
    kept = ["row", "doc_id", *(f"tokens.{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))]
    links = aligned.select("row", F.explode(F.arrays_zip("tokens.pairs", "tokens.times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    if n_counts <= broadcast_rows:
        met = links.join(F.broadcast(counts), "pair")
    else:
        hot = F.broadcast(counts.where(F.col("count") > total / 1_000))  # fewer than 1,000 rows
        met = links.join(hot, "pair").unionByName(links.join(hot.select("pair"), "pair", "left_anti").join(counts, "pair"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return (
        aligned.select(*kept)
        .join(sums, "row", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    )
