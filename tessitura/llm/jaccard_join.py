"""N-gram Jaccard self-join by PartEnum signatures, with connected components.

A document's features are the 64-bit hashes of its distinct `words`-word shingles (a text with
fewer words is one shingle; one without words has no features and no links). Documents with equal
feature sets form a class, known by the digest of the set; the join works on classes.

Sizes are cut into bands, and a set goes into the band of its size, and into the next one if it is
large enough to be similar to a set there. Two similar sets of one band differ in at most k
features. The feature domain is hashed into n1 groups of n2 partitions. Some groups differ in at
most k2 features, so at least n2 - k2 of their partitions are equal: every subset of so many
partitions of a group is a signature, and similar sets share one. A subset that holds no feature
is a signature only for sets in which more groups have such a subset than the spare groups allow;
two sets that agree in empty subsets alone are both of that kind.

Signatures that only one class has are dropped first: tasks send the hashes of their signatures, each
once, to the place where equal ones meet, and a bit map of bounded size that marks the shared ones
goes back to all tasks. (Where it is too full to help, more signatures go on; none is lost.)

Sets that share a signature are a bucket. First each set is compared with the bucket's first and
last class, a number of pairs linear in the bucket, and linked classes are joined into components.
Then only pairs of different components that lie between these two classes are left (none in a bucket of
three or fewer, as most are); they are compared in blocks of at most about
`block` classes, by bit maps that hold the parity of the features in each cell: two sets differ in at
least as many features as their maps differ in bits. Pairs that pass, mostly very near ones, are
compared by their whole feature sets, so no link is lost and none is invented. That is done twice:
first each block gives only pairs that span what its maps connect, which joins most components,
and then every pair that still lies between components.

Nulls are texts without words. Ids are of any type that has an order. Documents with a null id take part, and have as component the least
id of their component, null if it has none. Repeated documents fall into one class. An empty table gives no rows; other
columns of the documents take no part.

Classes are known by 64 bits: among 10^9 different texts, two that share a class by chance are expected about 0.03 times.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stages, sized_broadcast

#: (k2, n2): differences that a group may hold, and its partitions.
SCHEME = (1, 2)
#: Buckets that a class names to have a pair from one bucket.
LISTED = 16
#: Most bits of the map of shared signatures: 32 MB.
MOST_BITS = 28
#: Each band's sizes are below this times those of the band before.
BAND = 1.25
#: Bytes kept of a signature; the map of shared ones reads no more.
SIG_BYTES = 6
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, words: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, _U)
    h = np.fromiter(map(hashes.__getitem__, found), _U, len(found))
    if len(h) < words:
        return mix(np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(h)) + len(h) & (2**64 - 1)], _U))
    total = np.zeros(len(h) - words + 1, _U)
    for i in range(words):
        total = mix(total + h[i : len(h) - words + 1 + i])
    return np.unique(total)


def set_digest(features: np.ndarray) -> int | None:
    """64-bit id of a class, signed; None for the empty set."""
    return int(np.array(xxhash.xxh3_64_intdigest(features.tobytes()), _U).astype(np.int64)) if len(features) else None


def band_limits() -> list[int]:
    """First sizes of the bands."""
    limits = [1]
    while limits[-1] < 1 << 40:
        limits.append(max(limits[-1] + 1, int(limits[-1] * BAND)))
    return limits


LIMITS = band_limits()


class Signer:
    """Signatures for links at `percent` percent of Jaccard similarity."""

    def __init__(self, percent: int, scheme: tuple[int, int] = SCHEME):
        self.percent, (self.k2, self.n2) = percent, scheme
        self.subsets = np.array(list(combinations(range(self.n2), self.n2 - self.k2)))
        self.plans: dict[int, tuple[int, int]] = {}

    def differences(self, band: int) -> int:
        """The most features in which two similar sets of this band differ."""
        return 2 * (100 - self.percent) * (LIMITS[band + 1] - 1) // (100 + self.percent)

    def plan(self, band: int) -> tuple[int, int]:
        """(groups, spare): spare groups cover the groups that are likely to have an empty subset."""
        if band not in self.plans:
            bad, spare = self.differences(band) // (self.k2 + 1), 0
            least = max(1.0, self.percent * LIMITS[band] / 100)
            for _ in range(8):
                groups = bad + 1 + spare
                empty = groups * len(self.subsets) * np.exp(-least * self.subsets.shape[1] / (groups * self.n2))
                spare = int(min(bad + 2, np.ceil(empty + 2 * np.sqrt(empty))))
            self.plans[band] = bad + 1 + spare, spare
        return self.plans[band]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        n = len(features)
        band = int(np.searchsorted(LIMITS, n, side="right")) - 1
        found = [self.in_band(features, band)]
        if 100 * n >= self.percent * LIMITS[band + 1]:
            found.append(self.in_band(features, band + 1))
        return np.concatenate(found)

    def in_band(self, features: np.ndarray, band: int) -> np.ndarray:
        k = self.differences(band)
        if not k:  # only equal sets are similar, and those are one class
            return np.zeros(0, _U)
        groups, spare = self.plan(band)
        cells = groups * self.n2
        place = (mix(features + _U(band * 2 + 1)) % _U(cells)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        sums = np.zeros(cells + 1, _U)
        np.cumsum(mix(features ^ _U(0x5851F42D4C957F2D))[order], out=(running := np.zeros(len(features) + 1, _U))[1:])
        edges = np.searchsorted(place[order], np.arange(cells + 1))
        sums = (running[edges[1:]] - running[edges[:-1]]).reshape(groups, self.n2)
        counts = np.diff(edges).reshape(groups, self.n2)
        held = counts[:, self.subsets].sum(axis=2)
        weights = _U(2) * np.arange(self.n2, dtype=_U) + _U(0x9E3779B97F4A7C15)
        value = (mix(sums * weights)[:, self.subsets]).sum(axis=2, dtype=_U)
        index = np.arange(value.size, dtype=_U).reshape(value.shape)
        value = mix(value ^ mix(index + _U((band << 32) + (self.n2 << 24))))
        empty = held == 0
        if (empty.any(axis=1)).sum() < 1 + spare:
            return value[~empty]
        return value.ravel()


def _bytes(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if len(x) else np.zeros(0, np.int64))


def pack(values: np.ndarray) -> bytes:
    """The upper 48 bits of each signature: a chance meeting costs a comparison, no link."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SIG_BYTES :].tobytes()


def unpack(data: bytes) -> np.ndarray:
    found = np.zeros((len(data) // SIG_BYTES, 8), np.uint8)
    found[:, 8 - SIG_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, SIG_BYTES)
    return found.view("<u8").ravel()


def parity_map(features: np.ndarray) -> bytes:
    """Parity of the number of features in each of 2^i cells, more than features, or in large sets two thirds as many."""
    bits = max(64, 1 << (len(features) * 3 // 2 if len(features) < 700 else len(features) * 2 // 3).bit_length())
    odd = np.bincount((features >> _U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold_map(words: np.ndarray, size: int) -> np.ndarray:
    """A parity map (rows of 64-bit words) with fewer cells."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def signed_documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, class and signatures (packed) of documents with columns doc_id, text."""

    def run(batches):
        hashes, signer = _WordHashes(), Signer(percent)
        for batch in batches:
            sets = [shingle_set(t, words, hashes) for t in _bytes(batch.column("text"))]
            sigs = [pack(signer.signatures(s)) if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "cid", "sigs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, cid long, sigs binary")


def shared_map(signed: DataFrame, total: int, most_bits: int) -> tuple[np.ndarray, int]:
    """Bit map (and the log of its size) of the signatures that occur at least twice, by their first bits."""
    cut = min(16, max(4, (total // 4_000_000).bit_length()))
    bits = min(most_bits, max(cut + 3, (16 * total).bit_length()))

    def send(batches):
        def packed(held):
            value, count = np.unique(np.concatenate(held), return_counts=True)
            rest = ((value << _U(cut)) >> _U(32)).astype(np.uint32)
            edges = np.searchsorted(value >> _U(64 - cut), np.arange((1 << cut) + 1, dtype=_U))
            rows = [(p, rest[a:b][count[a:b] == 1].tobytes(), rest[a:b][count[a:b] > 1].tobytes()) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["p", "once", "more"])

        held, n = [], 0
        for batch in batches:
            for sigs in batch.column("sigs").to_pylist():
                if sigs:
                    held.append(unpack(sigs))
                    n += len(held[-1])
            if n > 2_000_000:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def meet(table: pa.Table) -> pa.Table:
        once = np.sort(np.frombuffer(b"".join(table.column("once").to_pylist()), np.uint32))
        more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint32)
        shared = np.concatenate([once[1:][once[1:] == once[:-1]], more, np.intersect1d(once, more)])
        flags = np.zeros(1 << (bits - cut), np.uint8)
        flags[shared >> np.uint32(32 - (bits - cut))] = 1
        return pa.table({"p": pa.array([table.column("p")[0].as_py()], pa.int64()), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    rows = signed.select("sigs").mapInArrow(send, "p long, once binary, more binary").groupBy("p").applyInArrow(meet, "p long, flags binary")
    size = 1 << (bits - cut) >> 3
    found = np.zeros(1 << bits >> 3, np.uint8)
    stages = Stages(signed.sparkSession)
    parts = stages.write(rows)
    for row in parts.toLocalIterator():  # a file's part of the map in the driver at a time, beside the map
        found[row.p * size : (row.p + 1) * size] = np.frombuffer(row.flags, np.uint8)
    stages.drop(parts)
    return found, bits


def shared_signatures(signed: DataFrame, total: int, most_bits: int) -> DataFrame:
    """(sig, cid) of the signatures that the map marks; of all if there are so many that a map would mark most of them."""
    found, bits = shared_map(signed, total, most_bits) if total <= 4 << most_bits else (np.full(1, 255, np.uint8), 3)
    sent = signed.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for batch in batches:
            sigs, cids = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
            for cid, data in zip(batch.column("cid").to_pylist(), batch.column("sigs").to_pylist()):
                if data:
                    values = unpack(data)
                    place = values >> _U(64 - bits)
                    values = values[(sent.value[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1]
                    sigs.append(values)
                    cids.append(np.full(len(values), cid, np.int64))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sigs)), pa.array(np.concatenate(cids))], ["sig", "cid"])

    return signed.select("cid", "sigs").mapInArrow(run, "sig long, cid long")


def class_texts(docs: DataFrame, wanted: DataFrame, n: int | None = None) -> DataFrame:
    """The texts of the documents whose keys stand in `wanted` (cid, doc_key), which is one for each class."""
    return docs.join(sized_broadcast(wanted.select("doc_key").distinct(), n), "doc_key", "left_semi").select("text")


def parity_maps(texts: DataFrame, words: int) -> DataFrame:
    """(cid, n, parity) of the texts that have features; a task gives each class once."""

    def run(batches):
        hashes, seen = _WordHashes(), set()
        for batch in batches:
            sets = {}
            for s in (shingle_set(t, words, hashes) for t in _bytes(batch.column("text"))):
                if len(s) and (cid := set_digest(s)) not in seen:
                    seen.add(cid)
                    sets[cid] = s
            columns = [pa.array(list(sets), pa.int64()), pa.array([len(s) for s in sets.values()], pa.int64()), pa.array([parity_map(s) for s in sets.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "n", "parity"])

    return texts.mapInArrow(run, "cid long, n long, parity binary")


def feature_sets(texts: DataFrame, words: int) -> DataFrame:
    """(cid, features) of the texts that have features."""

    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            sets = [s for s in (shingle_set(t, words, hashes) for t in _bytes(batch.column("text"))) if len(s)]
            features = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.int64()), features], ["cid", "features"])

    return texts.mapInArrow(run, "cid long, features array<long>")


def near_in_block(sig: int, i_block: int, j_block: int, cids: list, comps: list, sizes: list, parities: list, shared: list, owns: list, percent: int, spanning: bool):
    """Of two blocks (pairs inside one are left to where it is alone), pairs (a, b) of different components whose sizes and parity maps allow a link; with `spanning`
    only so many that they connect what all of them do, else, where their lists `shared` have a bucket
    in common, only in the least such bucket, so that most pairs come from one bucket."""
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    sets: dict = {}

    def held(i):
        if i not in sets:
            sets[i] = frozenset(shared[i])
        return sets[i]

    comp, n, own = np.array(comps), np.array(sizes), np.array(owns)
    width = min(map(len, parities)) // 8
    maps = np.concatenate([fold_map(np.frombuffer(p, _U)[None, :], width) for p in parities])
    for i in range(len(cids) - 1):
        other = comp[i + 1 :] != comp[i]
        if i_block != j_block:
            other &= own[i + 1 :] != own[i]
        j = np.flatnonzero(other) + i + 1
        j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
        if len(j):
            apart = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
            for k in j[(100 + percent) * apart <= (100 - percent) * (n[j] + n[i])]:
                if spanning:
                    low, high = root(comps[i]), root(comps[k])
                    if low == high:
                        continue
                    parent[high] = low
                elif shared[i] and shared[k] and min(held(i) & held(k), default=sig) != sig:
                    continue
                yield min(cids[i], cids[k]), max(cids[i], cids[k])


def near_pairs(rows: DataFrame, percent: int, spanning: bool = False) -> DataFrame:
    """(a, b) from rows (sig, i, j, cid, comp, n, parity, shared, own) that come grouped by sig, i, j."""

    def solve(group):
        return list(near_in_block(*group[0][:3], *list(zip(*group))[3:], percent, spanning)) if len(group) > 1 else []

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        group, out = [], set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("sig", "i", "j", "cid", "comp", "n", "parity", "shared", "own"))):
                if group and row[:3] != group[-1][:3]:
                    out.update(solve(group))
                    group = []
                    if len(out) > 50_000:
                        yield batch_of(out)
                        out = set()
                group.append(row)
        out.update(solve(group))
        yield batch_of(out)

    return rows.select("sig", "i", "j", "cid", "comp", "n", "parity", "shared", "own").mapInArrow(run, "a long, b long")


def verify(stages: Stages, pairs: DataFrame, docs: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b), repeated ones once, with 100 * |intersection| >= percent * |union|. Feature sets are
    made anew, from the texts of the classes that have pairs left."""
    pairs = stages.write(pairs.distinct())
    ids = stages.write(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct())
    n = ids.count()
    texts = class_texts(docs, wanted.join(sized_broadcast(ids, n), "cid", "left_semi"), n)
    some = stages.write(feature_sets(texts, words).join(sized_broadcast(ids, n), "cid", "left_semi").dropDuplicates(["cid"]))
    left = some.select(F.col("cid").alias("a"), F.col("features").alias("fa"))
    right = some.select(F.col("cid").alias("b"), F.col("features").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    linked = pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("fa") + F.size("fb") - both))
    linked = stages.write(linked.select("a", "b"))
    stages.drop(pairs, ids, some)
    return linked


def connected_components(stages: Stages, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(cid, comp) for every node of the links (a, b); comp is the least node of its component.

    Alternating large-star and small-star steps; each round is written, none is collected. A round
    that leaves the number of edges and two sums of their hashes as they were has changed nothing.
    """
    edges = stages.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = stages.write(small)
        stages.drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds; allow more")
    return edges.select(F.col("a").alias("cid"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("cid"), F.col("b").alias("comp")).distinct())


def similar_classes(docs: DataFrame, signed: DataFrame, stages: Stages, words: int, percent: int, block: int, most_bits: int) -> DataFrame | None:
    """(cid, comp) of the classes that links join, directly or by way of others; None without shared
    signatures. `signed` is dropped as soon as its signatures have been used."""
    classed = signed.where("cid is not null").withColumn("doc_key", F.xxhash64("doc_id"))
    copied = stages.write(classed.groupBy("cid").agg(F.count("*").alias("c"), F.min("doc_key").alias("first_key")).where("c > 1").drop("c"))
    single = classed.join(sized_broadcast(copied), "cid", "left").where("first_key is null or doc_key = first_key")
    total = int(single.agg(F.coalesce(F.sum(F.length("sigs")), F.lit(0))).first()[0]) // SIG_BYTES
    marked = shared_signatures(single, total, most_bits)
    marked = stages.write(marked)
    shared = stages.write(marked.groupBy("sig").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high"))
    buckets = stages.write(marked.join(shared, "sig").select("sig", "cid", "low", "high").distinct())
    stages.drop(marked, shared)
    wanted = stages.write(single.select("cid", "doc_key").join(buckets.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.min("doc_key").alias("doc_key")))
    n_wanted = wanted.count()
    if not n_wanted:
        stages.drop(signed)
        return None
    keyed = docs.select(F.xxhash64("doc_id").alias("doc_key"), "text")
    stages.drop(signed)
    maps = parity_maps(class_texts(keyed, wanted, n_wanted), words).join(sized_broadcast(wanted.select("cid"), n_wanted), "cid", "left_semi")
    maps = stages.write(maps.dropDuplicates(["cid"]))

    def ordered(x: str, y: str):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    stars = buckets.select(*ordered("cid", "low")).unionByName(buckets.select(*ordered("cid", "high"))).where("a < b").distinct()
    sides = stars.withColumns({"sig": F.col("a"), "i": F.col("b"), "j": F.lit(0).cast("long")}).select("sig", "i", "j", F.explode(F.array("a", "b")).alias("cid"))
    apart = sides.join(maps, "cid").withColumn("comp", F.col("cid")).withColumn("own", F.col("cid")).withColumn("shared", F.lit(None).cast("array<long>")).repartition("sig", "i").sortWithinPartitions("sig", "i", "j")
    links = verify(stages, near_pairs(apart, percent), keyed, wanted, words, percent)
    inner = stages.write(inner_members(buckets))
    stages.drop(buckets)
    comps = stages.write(connected_components(stages, links))
    for spanning in (True, False):
        inside = mixed_members(stages, inner, comps, block)
        grouped = mixed_blocks(inside, not spanning).join(maps, "cid").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        more = verify(stages, near_pairs(grouped, percent, spanning), keyed, wanted, words, percent)
        stages.drop(inside)
        comps = stages.write(join_components(stages, comps, more))
    stages.drop(inner, maps)
    return comps


def inner_members(buckets: DataFrame) -> DataFrame:
    """(sig, cid) of the classes that are neither first nor last in a bucket: those two have been compared with all of it."""
    return buckets.where("cid <> low and cid <> high").select("sig", "cid")


def mixed_members(stages: Stages, buckets: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """(sig, cid, comp, blocks, own) of buckets with several components."""
    placed = stages.write(buckets.select("sig", "cid").join(comps, "cid", "left").select("sig", "cid", F.coalesce("comp", "cid").alias("comp")))
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c")).where("low < high")
    inside = placed.join(mixed.select("sig", F.ceil(F.col("c") / block).alias("blocks")), "sig").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks"))
    inside = stages.write(inside)
    stages.drop(placed)
    return inside


def mixed_blocks(inside: DataFrame, lists: bool) -> DataFrame:
    """(sig, cid, comp, shared, own, i, j): the members in pairs of blocks. `shared` are the `LISTED` least
    of the buckets of a class, if `lists`."""
    if lists:
        inside = inside.join(inside.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LISTED).alias("shared")), "cid")
    else:
        inside = inside.withColumn("shared", F.lit(None).cast("array<long>"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    return inside.select("sig", "cid", "comp", "shared", "own", other).select("sig", "cid", "comp", "shared", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def join_components(stages: Stages, comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between classes, by way of the graph of components."""
    a, b = comps.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("cid").alias("b"), F.col("comp").alias("cb"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = stages.write(connected_components(stages, between)).select(F.col("cid").alias("comp"), F.col("comp").alias("root"))
    nodes = comps.unionByName(joined.select(F.col("comp").alias("cid"), "comp")).distinct()
    return nodes.join(joined, "comp", "left").select("cid", F.coalesce("root", "comp").alias("comp")).distinct()


def jaccard_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85, block: int = 1024, most_bits: int = MOST_BITS
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id of its component), class_id."""
    stages = Stages(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = stages.write(signed_documents(rows, words, percent))
    members = stages.write(signed.drop("sigs"))
    comps = similar_classes(rows, signed, stages, words, percent, block, most_bits)
    least = members.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    if comps is None:
        grouped = least.where("n > 1").select("cid", F.col("first_id").alias("component_id"))
    else:
        joined = least.join(comps, "cid", "left").where("n > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "cid"))
        joined = stages.write(joined)
        ids = joined.groupBy("comp").agg(F.min("first_id").alias("component_id"))
        grouped = joined.join(ids, "comp").select("cid", "component_id")
    grouped = stages.write(grouped)
    out = members.join(sized_broadcast(grouped), "cid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cid").alias("class_id"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS c FROM sh GROUP BY doc_id),
rep AS (SELECT c, min(doc_id) AS r FROM cls GROUP BY c),
rs AS (SELECT sh.doc_id, sh.g FROM sh JOIN rep ON sh.doc_id = rep.r),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk(x, y) AS (SELECT r, r FROM rep UNION SELECT walk.x, both_ways.y FROM walk JOIN both_ways ON walk.y = both_ways.x),
comp AS (SELECT x, min(y) AS component_id FROM walk GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN cls ON d.doc_id = cls.doc_id
LEFT JOIN rep ON cls.c = rep.c LEFT JOIN comp ON rep.r = comp.x
"""
