"""Mixing sources to target word counts by entropy balancing, in DataFrame operations only.

Every document has a rate, the number of times that the mix takes it. Among all rates that give
each source its target number of words, entropy balancing picks those of least relative entropy
to one copy each: exp(multiplier * size / mean size of the source), at most `most`. Rates depend
on source and size alone, so Newton's iterations on the dual run over the histogram
(source, size, documents). They are kept inside a bracket, which makes them converge.

All sums are of longs or decimals, so the order in which rows arrive changes nothing.

Rates become copies: a document gets the whole part of its rate, and its broken part decides with
a hash of its id whether it gets one more. Documents stand in the order hash / broken part; each
source takes them until its target is full. The place where it is full is found by summing sizes
in 4096 bins, then in 4096 parts of one bin, then over the few distinct (place, id, size) of one part,
so no task ever holds a source. The document at that place gives only the words still missing; where
rows that are equal in id and size stand there, they are numbered by partition, and the first ones are taken.

A null text has size 0 and is never taken. Null sources are one source, last in order. Sources
without words have target 0. Repeated documents, and documents with a null id, are separate
documents. Empty tables give no rows. `carry` names columns of the documents to pass through; a
column of theirs with the name of a result column can't be carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Stages, sized_broadcast

WORDS = r"[^\x20\x09-\x0D]+"
BINS = 4096
LN2 = math.log(2.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source: its words, documents and target. Targets stop at `most` times the source's words;
    what is above is shared again by weight. One row per source."""
    everything = Window.partitionBy(F.lit(1))
    by_ratio = everything.orderBy("ratio", "sk")
    totals = sizes.groupBy("sk").agg(
        F.first("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.sum((F.col("size") > 0).cast("long")).alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    place = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    ranked = (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("words", F.lit(float(share)) * F.sum("source_size").over(everything))
    )
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("words") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    level = ranked.withColumn("level", left / rest)
    level = level.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("level"), F.lit(0.0)))
    return level.select("sk", "source_size", "docs", "least", target.alias("target"))


def rate(most: float):
    tilt = F.col("tilt") * F.col("size") / F.col("mean")
    return F.when(tilt >= math.log(most), F.lit(float(most))).otherwise(F.exp(tilt))


def exact(x: Column) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def entropy_balance(stages: Stages, histogram: DataFrame, targets: DataFrame, most: float, rounds: int, tolerance: float) -> DataFrame:
    """Per source the multiplier `tilt` at which the rates give the target."""
    short = F.col("target") < F.col("source_size")
    state = stages.write(
        targets.where(F.col("source_size") > 0)
        .withColumn("mean", F.col("source_size") / F.col("docs"))
        .withColumn("low", F.when(short, F.lit(-1e12)).otherwise(0.0))
        .withColumn("high", F.when(short, 0.0).otherwise(F.lit(math.log(most)) * F.col("mean") / F.col("least")))
        .withColumn("tilt", F.when(F.col("target") >= F.lit(float(most)) * F.col("source_size"), F.col("high")).otherwise(F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-9)))))
    )
    sources = state.count()
    for _ in range(rounds):
        joined = histogram.join(sized_broadcast(state, sources), "sk")
        words = F.col("n") * F.col("size")
        free = rate(most) < most
        sums = joined.groupBy("sk").agg(
            exact(words * rate(most)).alias("got"),
            exact(F.when(free, words * F.col("size") / F.col("mean") * rate(most)).otherwise(0.0)).alias("slope"),
            *(F.first(c).alias(c) for c in ("source_size", "docs", "least", "target", "mean", "tilt", "low", "high")),
        )
        over = F.col("got") > F.col("target")
        gap = (F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))).alias("gap")
        low = F.when(over, F.col("low")).otherwise(F.greatest("low", "tilt"))
        high = F.when(over, F.least("high", "tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("new_low")) & (step < F.col("new_high"))
        moved = (
            sums.withColumn("gap", gap)
            .withColumn("new_low", low)
            .withColumn("new_high", high)
            .withColumn("next", F.when(inside, step).otherwise((F.col("new_low") + F.col("new_high")) / 2))
        )
        after = stages.write(
            moved.select(
                "sk", "source_size", "docs", "least", "target", "mean",
                F.when(F.col("gap") <= tolerance, F.col("tilt")).otherwise(F.col("next")).alias("tilt"),
                F.col("new_low").alias("low"), F.col("new_high").alias("high"), "gap",
            )
        )
        stages.drop(state)
        worst = after.agg(F.max("gap")).first()[0]
        state = after.drop("gap")
        state._staged_at = after._staged_at
        if worst is None or worst <= tolerance:
            return state
    raise RuntimeError(f"rates are off their targets by {worst} after {rounds} rounds; allow more rounds or a larger tolerance")


def full_bin(sums: DataFrame, bin_col: str, need: str) -> DataFrame:
    """Per source the bin in which the running sum of words reaches `need`, and what is missing before it."""
    running = Window.partitionBy("sk").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(running), F.lit(0))
    return (
        sums.withColumn("before", before)
        .where((F.col("before") < F.col(need)) & (F.col("before") + F.col("words") >= F.col(need)))
        .select("sk", F.col(bin_col).alias(f"{bin_col}_full"), (F.col(need) - F.col("before")).alias(f"{bin_col}_rest"))
    )


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    rounds: int = 60,
    tolerance: float = 1e-6,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and source, rate and the columns of `carry`.

    `weights` go to the sources in code point order, repeating; `share` of all words are shared out.
    """
    stages = Stages(docs.sparkSession)
    if set(carry) & {"doc_id", "size", "source_size", "target", "taken", "source", "rate"}:
        raise ValueError("a carried column has the name of a result column")

    def sized(extra: tuple[str, ...]) -> DataFrame:
        return docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source))).alias("sk"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long").alias("size"),
            *(F.struct(*extra).alias("carried") for _ in extra[:1]),
        )

    sizes = stages.write(sized(()))
    targets = stages.write(source_targets(sizes, weights, share, most))
    histogram = stages.write(sizes.where("size > 0").groupBy("sk", "size").agg(F.count("*").alias("n")))
    tilts = entropy_balance(stages, histogram, targets, most, rounds, tolerance)
    sources = targets.count()

    whole = F.floor(rate(most))
    need = stages.write(
        histogram.join(sized_broadcast(tilts, sources), "sk")
        .groupBy("sk", "target")
        .agg(F.sum(F.col("n") * F.col("size") * whole).alias("sure"))
        .select("sk", F.greatest(F.round("target").cast("long") - F.col("sure"), F.lit(0)).alias("need"))
    )
    per_source = stages.write(
        targets.select("sk", "source_size", "target").join(tilts.select("sk", "mean", "tilt"), "sk", "left").join(need, "sk", "left")
    )
    chance = F.xxhash64("doc_id", F.lit("mix")).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))

    def rated(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("pid", F.spark_partition_id())
            .join(sized_broadcast(per_source, sources), "sk")
            .withColumn("rate", F.when(F.col("size") > 0, rate(most)).otherwise(0.0))
            .withColumn("copies", F.floor("rate"))
            .withColumn("part", F.col("rate") - F.col("copies"))
            .withColumn("place", F.when(F.col("part") > 0, chance / (chance + F.col("part"))) * BINS)
            .withColumn("bin", F.floor("place"))
            .withColumn("cell", F.floor((F.col("place") - F.col("bin")) * BINS))
        )

    open_docs = rated(sizes).where("place is not null")
    bins = open_docs.groupBy("sk", "need", "bin").agg(F.sum("size").alias("words"))
    at_bin = stages.write(full_bin(bins, "bin", "need"))
    near = open_docs.join(sized_broadcast(at_bin, sources), "sk").where("bin = bin_full")
    cells = near.groupBy("sk", "bin_rest", "cell").agg(F.sum("size").alias("words"))
    at_cell = stages.write(full_bin(cells, "cell", "bin_rest"))
    edges = stages.write(at_bin.join(at_cell, "sk", "left").select("sk", "bin_full", "cell_full", "cell_rest"))

    # Distinct (place, doc_id, size) of the last cell, with what is missing before each, and the one at which its source is full.
    alike = ["sk", "place", "doc_id", "size"]
    last = open_docs.join(sized_broadcast(edges, sources), "sk").where("bin = bin_full and cell = cell_full")
    groups = last.groupBy(*alike, "cell_rest").agg(F.count("*").alias("n"))
    running = Window.partitionBy("sk").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("missing", F.col("cell_rest") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(running), F.lit(0)))
    full = stages.write(groups.where("missing > 0 and missing <= n * size").select("sk", "missing", "n", *(F.col(c).alias(f"full_{c}") for c in alike[1:])))
    repeated = full.agg(F.max("n")).first()[0]

    def placed(rows: DataFrame) -> DataFrame:
        found = rated(rows).join(sized_broadcast(edges, sources), "sk", "left").join(sized_broadcast(full, sources), "sk", "left")
        mine = F.struct("place", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size")
        limit = F.struct(F.col("full_place").alias("place"), F.col("full_doc_id").isNotNull().alias("known"), F.col("full_doc_id").alias("doc_id"), F.col("full_size").alias("size"))
        in_cell = (F.col("bin") == F.col("bin_full")) & (F.col("cell") == F.col("cell_full"))
        earlier = (F.col("bin") < F.col("bin_full")) | ((F.col("bin") == F.col("bin_full")) & (F.col("cell") < F.col("cell_full")))
        before = F.coalesce(F.col("place").isNotNull() & (earlier | (in_cell & (mine < limit))), F.lit(False))
        return found.withColumn("at", F.coalesce(in_cell & (mine == limit), F.lit(False))).withColumn("before", before)

    def taken(rows: DataFrame, turn: Column) -> DataFrame:
        given = F.greatest(F.least(F.col("missing") - turn * F.col("size"), F.col("size")), F.lit(0))
        extra = F.when(F.col("before"), F.col("size")).when(F.col("at"), given).otherwise(F.lit(0))
        words = (F.col("copies") * F.col("size") + extra).cast("long").alias("taken")
        return rows.select("doc_id", "size", "source_size", "target", words, "source", "rate", *(F.col(f"carried.{c}").alias(c) for c in carry))

    rows = placed(sized(carry) if carry else sizes)
    if (repeated or 0) <= 1:
        return taken(rows, F.lit(0))
    held = rows.where("at")
    offset = Window.partitionBy("sk").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("sk", "pid").agg(F.count("*").alias("c")).select("sk", "pid", F.coalesce(F.sum("c").over(offset), F.lit(0)).alias("offset"))
    turn = F.row_number().over(Window.partitionBy("sk", "pid").orderBy("size")) - 1
    numbered = held.withColumn("in_part", turn).join(offsets, ["sk", "pid"])
    return taken(rows.where("not at"), F.lit(0)).unionByName(taken(numbered, F.col("offset") + F.col("in_part")))
