"""Ratings from votes: one vote per user, item and UTC day, means drawn to the global mean."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import adjusted_rating, confidence, work_weight


class Votes(NamedTuple):
    kept: DataFrame
    rejects: DataFrame


def first_vote_of_day(
    votes: DataFrame, *, user: str = "user_id", item: str = "work_id", vote: str = "vote", ts: str = "voted_at", id: str = "id", lo: int = 1, hi: int = 5
) -> Votes:
    """The first vote of a user for an item on a UTC day; others and votes out of range are rejects."""
    fair = F.col(vote).between(lo, hi)
    day = F.to_date(F.col(ts))
    turn = F.row_number().over(Window.partitionBy(user, item, "vote_day", "_fair").orderBy(ts, id))
    ranked = votes.withColumn("vote_day", day).withColumn("_fair", F.coalesce(fair, F.lit(False))).withColumn("_turn", turn)
    good = F.col("_fair") & (F.col("_turn") == 1)
    reason = F.when(~F.col("_fair"), "out_of_range").otherwise("same_day")
    return Votes(ranked.where(good).drop("_fair", "_turn"), ranked.where(~good).withColumn("reason", reason).drop("_fair", "_turn"))


def item_ratings(
    votes: DataFrame, *, user: str = "user_id", item: str = "work_id", vote: str = "vote", ts: str = "voted_at", id: str = "id", m: float = 5, lo: int = 1, hi: int = 5
) -> DataFrame:
    """A1: per item rating, adjusted_rating, vote_count, work_count and confidence."""
    kept = first_vote_of_day(votes, user=user, item=item, vote=vote, ts=ts, id=id, lo=lo, hi=hi).kept
    sums = kept.groupBy(item).agg(F.sum(F.col(vote).cast("double")).alias("_sum"), F.count("*").alias("vote_count"))
    total = sums.agg(F.coalesce(F.sum("_sum") / F.sum("vote_count"), F.lit(0.0)).alias("_mean"))
    rated = sums.crossJoin(F.broadcast(total)).withColumn("rating", F.col("_sum") / F.col("vote_count"))
    return rated.select(
        item,
        "rating",
        adjusted_rating(F.col("vote_count"), F.col("rating"), F.col("_mean"), m).alias("adjusted_rating"),
        "vote_count",
        F.lit(1).alias("work_count"),
        confidence(F.col("vote_count"), m).alias("confidence"),
    )


def group_ratings(items: DataFrame, groups: DataFrame, ratings: DataFrame, *, item: str = "work_id", group: str = "composer_id", m: float = 5) -> DataFrame:
    """A2: per active group the mean of adjusted ratings weighted by the root of the vote counts.
    `items` has (item, group), `groups` (group) of active ones."""
    joined = items.select(item, group).join(groups.select(group).distinct(), group).join(ratings.select(item, "adjusted_rating", "vote_count"), item, "left")
    n = F.coalesce("vote_count", F.lit(0))
    value = F.sum(F.col("adjusted_rating") * work_weight(n)) / F.nullif(F.sum(work_weight(n)), F.lit(0.0))
    sums = joined.groupBy(group).agg(value.alias("adjusted_rating"), F.sum(n).alias("vote_count"), F.count_distinct(item).alias("work_count"))
    return sums.select(group, F.col("adjusted_rating").alias("rating"), "adjusted_rating", "vote_count", "work_count", confidence(F.col("vote_count"), m).alias("confidence"))


def ratings_for(items: DataFrame, ratings: DataFrame, *, item: str = "work_id") -> DataFrame:
    """A3: every asked item; one without votes gets zeros and no rating."""
    zero = {"vote_count": F.lit(0).cast("long"), "work_count": F.lit(1), "confidence": F.lit(0.0)}
    joined = items.select(item).join(ratings, item, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in zero.items()})


def drop_orphans(stats: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Statistics whose key still has facts."""
    return stats.join(facts.select(key).distinct(), key, "left_semi")


class Refresh(NamedTuple):
    stats: DataFrame
    run: DataFrame


def refresh_statistics(votes: DataFrame, works: DataFrame, old: DataFrame | None = None, *, item: str = "work_id", m: float = 5, **columns) -> Refresh:
    """New item ratings of works that exist, and the run's record. Old rows without votes go."""
    stats = drop_orphans(item_ratings(votes, item=item, m=m, **columns), works, item)
    removed = F.lit(0) if old is None else None
    run = stats.agg(F.count("*").alias("works_updated"))
    if old is not None:
        run = run.crossJoin(F.broadcast(old.join(stats.select(item), item, "left_anti").agg(F.count("*").alias("works_removed"))))
    else:
        run = run.withColumn("works_removed", removed)
    return Refresh(stats, run)
