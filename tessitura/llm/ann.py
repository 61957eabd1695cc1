"""Approximate nearest neighbours by multiprobe p-stable hashing, nearness being the inner product.

Inner products become distances: candidates are scaled by the largest norm and get one more
component that makes them unit vectors, queries are scaled to unit length with a zero there. A table
hashes a vector by `functions` Gaussian projections, each cut into cells of `width`. A query visits
the buckets that differ from its own by -1, 0 or +1 in each cell number, in falling order of the
estimated probability that a neighbour is there, until the visited ones hold `reach` of it. The
candidates of all tables are merged and ranked by their exact inner products in double precision.
The distance of a neighbour, on which the estimate rests, is each query's own, from `sample` vectors
at most; every vector is indexed. A query that comes back with fewer than k neighbours, or for whose
k-th distance the buckets visited in all tables hold less than `reach` of the probability, is searched again in all
vectors.

Buckets are dealt into parts, and a part into blocks of rows; queries come in blocks too and go only
to parts that hold a bucket they visit, so a task holds one block of each. Equal vectors are one
candidate with the k + 1 least ids, which is all that ties can need, and equal queries are searched
once. Where different vectors tie at the end of a block's list, those of least ids stay.

Rows with a null id take no part, nor do vectors that are null, empty, zero, or hold null or
non-finite components. Vectors of different lengths have no inner product: each length is searched
by itself. A query with fewer than k candidates gets all of them. Repeated rows count once; different vectors under one
id are candidates of their own. Empty tables give no rows. Other columns take no part.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Stages, bounded_sample, sized_broadcast
from .jaccard_join import mix

ERF = np.vectorize(math.erf)


class ProbeHash:
    """Tables of p-stable hash functions and the order in which a query visits buckets."""

    def __init__(self, dim: int, norm: float, tables: int, functions: int, width: float, reach: float, seed: int):
        rng = np.random.default_rng(seed)
        self.norm, self.width, self.reach = norm, width, reach
        self.tables = [(rng.standard_normal((dim + 1, functions)), rng.random(functions) * width) for _ in range(tables)]

    def unit_rows(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.norm
        return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))])

    @staticmethod
    def unit_queries(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        directions, shift = self.tables[table]
        return (unit @ directions + shift) / self.width

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """One number per bucket; cell numbers lie far within -64 to 63."""
        places = np.left_shift(np.int64(1), 7 * np.arange(cells.shape[-1], dtype=np.int64))
        return ((np.clip(cells, -64, 63).astype(np.int64) + 64) * places).sum(axis=-1)

    def probes(self, unit: np.ndarray, near: np.ndarray, table: int):
        """(query, key) of all buckets that the queries visit."""
        query, step, low, steps, _ = self.visits(unit, near, table)
        return query, self.keys(low[query] + steps[step])

    def visits(self, unit: np.ndarray, near: np.ndarray, table: int):
        """(query, step) of visited buckets, the queries' own cells, all steps, and a bucket's place in its cells."""
        at = self.cells(unit, table)
        low = np.floor(at)
        inside = (at - low) * self.width
        steps = _steps(at.shape[1])
        chance = self.chances(inside, near, steps)
        order = np.argsort(-chance, axis=1)
        chance = np.take_along_axis(chance, order, axis=1)
        query, rank = np.nonzero(np.cumsum(chance, axis=1) - chance < self.reach)
        return query, order[query, rank], low, steps, inside

    def chances(self, inside: np.ndarray, near: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Per query and step, the estimated probability that a neighbour at distance `near` is there."""
        edges = np.stack([inside * 0 - self.width, inside * 0, inside * 0 + self.width, inside * 0 + 2 * self.width], axis=-1) - inside[..., None]
        share = 0.5 * (1 + ERF(edges / (near[:, None, None] * np.sqrt(2))))
        logs = np.log(np.maximum(np.diff(share, axis=-1), 1e-12))
        return np.exp(sum(logs[:, j][:, steps[:, j] + 1] for j in range(inside.shape[1])))

    def covered(self, unit: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Per query that visited for the distance `near`, the probability that a neighbour at distance `far` is seen in some table."""
        missed = np.ones(len(unit))
        for table in range(len(self.tables)):
            query, step, _, steps, inside = self.visits(unit, near, table)
            missed *= 1 - np.minimum(1.0, np.bincount(query, self.chances(inside, far, steps)[query, step], len(unit)))
        return 1 - missed


@lru_cache
def _steps(functions: int) -> np.ndarray:
    return np.array(list(product((-1, 0, 1), repeat=functions)))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, e) with finite, non-zero vectors in double precision."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where("vec_id is not null and size(e) > 0")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("e", lambda x: x != 0)).distinct()


def best_places(score: np.ndarray, cls: np.ndarray, margin: int, ties: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `margin` largest finite scores of each row; of those that tie with the last one the `ties` of least cls."""
    if score.shape[1] <= margin:
        return np.nonzero(np.isfinite(score))
    last = np.partition(score, score.shape[1] - margin, axis=1)[:, score.shape[1] - margin]
    spread = 1e-12 * np.maximum(1.0, np.abs(np.where(np.isfinite(last), last, 0.0)))[:, None]
    row, column = np.nonzero(score > last[:, None] + spread)
    rows, columns = [row], [column]
    tied = np.isfinite(score) & (np.abs(score - np.where(np.isfinite(last), last, 0.0)[:, None]) <= spread) & np.isfinite(last)[:, None]
    for r in np.flatnonzero(tied.any(axis=1)):
        at = np.flatnonzero(tied[r])
        at = at[np.argsort(cls[at])][:ties]
        rows.append(np.full(len(at), r))
        columns.append(at)
    return np.concatenate(rows), np.concatenate(columns)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 1))


class NeighbourDistance:
    """Each query's likely distance to its k nearest of `total` vectors, from a sample of them."""

    def __init__(self, sample: np.ndarray, model: ProbeHash, total: int, k: int):
        self.unit = model.unit_rows(sample)
        self.at = {row.tobytes(): i for i, row in enumerate(sample)}
        self.rank = min(len(sample) - 2, max(1, round(k * len(sample) / max(total, 1))))

    def of(self, y: np.ndarray) -> np.ndarray:
        if self.rank < 1:
            return np.ones(len(y))
        squares = np.maximum(0.0, 2 - 2 * ProbeHash.unit_queries(y) @ self.unit.T)
        for i, row in enumerate(y):
            if row.tobytes() in self.at:
                squares[i, self.at[row.tobytes()]] = np.inf
        return np.sqrt(np.maximum(np.partition(squares, self.rank, axis=1)[:, self.rank], 0.01))


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 20,
    tables: int = 2,
    functions: int = 8,
    width: float = 2.0,
    reach: float = 0.8,
    sample: int = 4096,
    block: int = 16_384,
    query_block: int = 4_096,
    seed: int = 11,
) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score. `queries` has the columns of `vectors`."""
    stages = Stages(vectors.sparkSession)
    rows = stages.write(valid_vectors(vectors, vec_id, embedding))
    asked = stages.write(valid_vectors(queries, vec_id, embedding).select(F.col("vec_id").alias("query_id"), "e"))
    lengths = sorted(r.n for r in asked.select(F.size("e").alias("n")).distinct().collect())
    found = None
    for n in lengths or [0]:
        some = of_one_length(rows.where(F.size("e") == n), asked.where(F.size("e") == n), stages, k, tables, functions, width, reach, sample, block, query_block, seed)
        found = some if found is None else found.unionByName(some)
    return found


def of_one_length(
    rows: DataFrame, asked: DataFrame, stages: Stages, k: int, tables: int, functions: int, width: float, reach: float, sample: int, block: int, query_block: int, seed: int
) -> DataFrame:
    """Neighbours among vectors of one length: (vec_id, e) and (query_id, e)."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    near_ids = Window.partitionBy("e").orderBy("vec_id")
    classes = rows.withColumn("turn", F.row_number().over(near_ids)).where(F.col("turn") <= k + 1)
    classes = stages.write(classes.groupBy("e").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cls", F.col("ids")[0]))
    distinct = stages.write(asked.groupBy("e").agg(F.min("query_id").alias("q")))
    n, n_queries = classes.count(), distinct.count()
    squares = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
    norm = classes.agg(F.max(squares)).first()[0]
    chosen = _matrix(bounded_sample(classes.select("cls", "e"), F.col("cls"), sample).toPandas()["e"])
    dim = chosen.shape[1] if len(chosen) else 1
    wide = 8 * dim + 64
    norm = float(np.sqrt(norm or 1.0))
    model = ProbeHash(dim, norm, tables, functions, width, reach, seed)
    distance = spark.sparkContext.broadcast(NeighbourDistance(chosen, model, n, k))

    def estimate(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(near=distance.value.of(_matrix(batch["e"])))

    distinct = stages.write(distinct.repartition(cores, "q").mapInPandas(estimate, "e array<double>, q long, near double"))
    parts, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))

    def index(batches):
        for batch in batches:
            unit = model.unit_rows(_matrix(batch["e"])) if len(batch) else None
            for t in range(tables if len(batch) else 0):
                keys = model.keys(np.floor(model.cells(unit, t)))
                yield pd.DataFrame({"t": t, "part": part_of(keys, parts), "key": keys, "cls": batch["cls"], "e": batch["e"]})

    def visit(batches):
        for batch in batches:
            unit = model.unit_queries(_matrix(batch["e"])) if len(batch) else None
            for t in range(tables if len(batch) else 0):
                query, keys = model.probes(unit, batch["near"].to_numpy(), t)
                pairs = np.unique(np.column_stack([query, part_of(keys, parts)]), axis=0)
                yield pd.DataFrame({"t": t, "part": pairs[:, 1], "q": batch["q"].to_numpy()[pairs[:, 0]], "e": batch["e"].to_numpy()[pairs[:, 0]], "near": batch["near"].to_numpy()[pairs[:, 0]]})

    indexed = stages.write(classes.select("cls", "e").mapInPandas(index, "t int, part long, key long, cls long, e array<double>"))
    sizes = indexed.groupBy("t", "part").agg(F.ceil(F.count("*") / (2 * block)).alias("blocks"))
    sizes = stages.write(sizes)
    blocks = sizes.count()
    placed = indexed.join(sized_broadcast(sizes, blocks), ["t", "part"])
    placed = placed.withColumn("b", F.pmod(F.xxhash64("cls"), "blocks")).drop("blocks")
    placed = placed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked_blocks = sizes.select("t", "part", F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1).alias("bs"))
    visits = distinct.mapInPandas(visit, "t int, part long, q long, e array<double>, near double").join(sized_broadcast(asked_blocks, blocks), ["t", "part"])
    visits = visits.select("t", "part", "q", "e", "near", F.explode("bs").alias("b"))
    visits = visits.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int"))
    margin = k + 5

    def rank_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return empty
        t, x, cls = int(left["t"].iloc[0]), _matrix(left["e"]), left["cls"].to_numpy()
        buckets, bucket = np.unique(left["key"].to_numpy(), return_inverse=True)
        out = []
        for low in range(0, len(right), 256):
            some = right.iloc[low : low + 256]
            y = _matrix(some["e"])
            query, keys = model.probes(model.unit_queries(y), some["near"].to_numpy(), t)
            at = np.minimum(np.searchsorted(buckets, keys), len(buckets) - 1)
            hit = buckets[at] == keys
            visited = np.zeros((len(some), len(buckets)), bool)
            visited[query[hit], at[hit]] = True
            score = np.where(visited[:, bucket], y @ x.T, -np.inf)
            at, top = best_places(score, cls, margin, k + 1)
            out.append(pd.DataFrame({"q": some["q"].to_numpy()[at], "cls": cls[top]}))
        return pd.concat(out)

    keys = ["t", "part", "b", "qb"]
    found = placed.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(rank_block, "q long, cls long").distinct()
    found = stages.write(found)
    product_sum = F.aggregate(F.zip_with("x", "e", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def ranked(found: DataFrame) -> DataFrame:
        """(q, l): the k + 1 best of the candidates, equal vectors by their least ids."""
        scored = found.join(classes, "cls").join(sized_broadcast(distinct.select("q", F.col("e").alias("x")), n_queries, wide), "q").withColumn("score", product_sum)
        best = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
        scored = scored.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
        ties = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        lists = scored.withColumn("turn", F.row_number().over(ties)).where(F.col("turn") <= k + 1).groupBy("q").agg(F.collect_list(F.struct("turn", "vec_id", "score")).alias("l"))
        return stages.write(lists)

    lists = ranked(found)

    def unsure(batches):
        for batch in batches:
            if not len(batch):
                continue
            y = _matrix(batch["e"])
            cosine = batch["last"].to_numpy(dtype=float) / (np.linalg.norm(y, axis=1) * norm)
            far = np.sqrt(np.maximum(2 - 2 * cosine, 0.01))
            seen = model.covered(model.unit_queries(y), batch["near"].to_numpy(), np.nan_to_num(far, nan=2.0))
            yield batch[(batch["n"].to_numpy() <= k) | ~(seen >= reach)][["q", "e"]]

    state = distinct.join(sized_broadcast(lists.select("q", F.size("l").alias("n"), F.array_min(F.transform("l", lambda c: c["score"])).alias("last")), n_queries), "q", "left").repartition(cores, "q")
    state = state.select("q", "e", "near", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last", F.lit(0.0)).alias("last"))
    again = stages.write(state.mapInPandas(unsure, distinct.select("q", "e").schema))
    n_again = again.count()
    if n_again:

        def rank_all(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"q": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64)})
            x, cls, out = _matrix(left["e"]), left["cls"].to_numpy(), []
            for low in range(0, len(right), 256):
                some = right.iloc[low : low + 256]
                score = _matrix(some["e"]) @ x.T
                at, top = best_places(score, cls, margin, k + 1)
                out.append(pd.DataFrame({"q": some["q"].to_numpy()[at], "cls": cls[top]}))
            return pd.concat(out)

        again_blocks = -(-n_again // query_block)
        rows_of = classes.select("cls", "e", F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(again_blocks - 1))).alias("qb"))
        asked_of = again.select("q", "e", F.pmod(F.xxhash64("q"), F.lit(again_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("b"))
        all_found = rows_of.groupBy("b", "qb").cogroup(asked_of.groupBy("b", "qb")).applyInPandas(rank_all, "q long, cls long")
        exact = ranked(stages.write(all_found))
        lists = stages.write(lists.join(sized_broadcast(again.select("q"), n_again), "q", "left_anti").unionByName(exact))
    ask = asked.join(sized_broadcast(distinct.select("q", "e"), n_queries, wide), "e").select("query_id", "q")
    own = F.slice(F.filter(F.array_sort("l"), lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    result = ask.join(sized_broadcast(lists, n_queries, 40 * k + 64), "q").select("query_id", F.posexplode(own).alias("p", "c"))
    return result.select("query_id", (F.col("p") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))
