"""Counts, coverage, gaps, distributions and top-N."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fold_key

REVIEW_STATES = ("correct", "incorrect", "reviewed", "not_reviewed")


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def snapshot(archives: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """A4: one row of repository counts; each table is read once."""
    a = archives.agg(
        F.count("*").alias("archives"),
        F.count_if(F.coalesce(F.col("local_path"), F.lit("")) != "").alias("downloaded"),
        F.count_if(F.col("status") == "materialized").alias("materialized"),
    )
    e = entries.agg(
        F.count("*").alias("entries"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "missing").alias("missing")
    )
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return a.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(f))


def latest_or(snapshots: DataFrame, compute: DataFrame, key: str = "id") -> DataFrame:
    """A5: the latest stored row, or the computed one where none is stored."""
    last = snapshots.orderBy(F.desc(key)).limit(1)
    marked = compute.withColumn(key, F.lit(None).cast(snapshots.schema[key].dataType))
    return last.unionByName(marked, allowMissingColumns=True).orderBy(F.desc_nulls_last(key)).limit(1)


def review_counts(df: DataFrame, status: str = "review_status", states: tuple[str, ...] = REVIEW_STATES) -> DataFrame:
    """Rows per state, states without rows at zero, null as not_reviewed, and `total`."""
    state = F.coalesce(F.col(status), F.lit("not_reviewed"))
    sums = [F.count_if(state == s).alias(s) for s in states]
    wide = df.agg(F.count("*").alias("total"), *sums)
    stacked = ", ".join(f"'{c}', `{c}`" for c in ("total", *states))
    return wide.selectExpr(f"stack({len(states) + 1}, {stacked}) as (state, n)")


def coverage(df: DataFrame, key: str) -> DataFrame:
    """Rows with and without a value, and their percentages."""
    has = F.count_if(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    sums = df.agg(F.count("*").alias("total"), has.alias("with_key")).withColumn("without_key", F.col("total") - F.col("with_key"))
    return sums.withColumns({f"{c}_pct": percent(F.col(c), F.col("total")) for c in ("with_key", "without_key")})


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows and share of each value, most frequent first."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("n"), "value")


def shape(df: DataFrame, visible: str = "visible", source: str = "source_system") -> DataFrame:
    """Total, visible and hidden rows per source, and of all (null source)."""
    sums = [F.count("*").alias("total"), F.count_if(F.col(visible)).alias("visible"), F.count_if(~F.coalesce(F.col(visible), F.lit(False))).alias("hidden")]
    per_source = df.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(*sums)
    return per_source.unionByName(df.agg(*sums).withColumn("source", F.lit("*")))


def top_by_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, n: int = 12) -> DataFrame:
    """A10: parents with most children; those without children count as zero."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("n"))
    return parents.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("n"), key).limit(n)


def gap_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without a value, per column, in one pass."""
    wide = df.agg(*(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in cols))
    stacked = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stacked}) as (column_name, gaps)")


class LongTail(NamedTuple):
    top: DataFrame
    distinct: DataFrame


def long_tail(df: DataFrame, col: str, n: int = 20) -> LongTail:
    """The most frequent values (equal under case, accents and trailing blanks), and how many there are."""
    groups = df.where(F.trim(F.coalesce(F.col(col), F.lit(""))) != "").groupBy(fold_key(F.col(col)).alias("key")).agg(F.min(col).alias("name"), F.count("*").alias("n"))
    return LongTail(groups.orderBy(F.desc("n"), "key").limit(n), groups.agg(F.count("*").alias("values")))


def candidate_priority(candidates: DataFrame, *, label: str | None = "real", n: int = 200, key: str = "name_key", name: str = "attribution", works: str = "work_count", label_col: str = "label") -> DataFrame:
    """Per name key the works of all variants, the variants, and the name of the largest; top n."""
    rows = candidates if label is None else candidates.where(F.col(label_col) == label)
    variants = rows.groupBy(key, name).agg(F.sum(works).alias("w"))
    sums = variants.groupBy(key).agg(F.sum("w").alias("works"), F.count("*").alias("variants"), F.min_by(name, F.struct(-F.col("w"), F.col(name))).alias("name"))
    return sums.orderBy(F.desc("works"), key).limit(n)


def authority_profile(authority: DataFrame, key: str = "name_key", fields: tuple[str, ...] = ("wikidata_id", "viaf_id", "imslp_id", "birth_date", "death_date")) -> DataFrame:
    """One row: rows, percentage with each field, keys, keys with several rows."""
    filled = [percent(F.count_if(F.coalesce(F.col(c), F.lit("")) != ""), F.count("*")).alias(f"{c}_pct") for c in fields]
    per_key = authority.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n"))
    keys = per_key.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("keys_with_several"))
    return authority.agg(F.count("*").alias("rows"), *filled).crossJoin(F.broadcast(keys))


def outcome_counts(df: DataFrame, col: str = "outcome") -> DataFrame:
    """Rows per outcome."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def entries_per_archive(entries: DataFrame, status: str | None = None) -> DataFrame:
    """Entries per archive, all or those of one status."""
    rows = entries if status is None else entries.where(F.col("status") == status)
    return rows.groupBy("archive_id").agg(F.count("*").alias("n"))


def with_child_count(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Parents with the number of their children."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


class Pruned(NamedTuple):
    kept: DataFrame
    removed: DataFrame


def prune_childless(parents: DataFrame, children: DataFrame, key: str, child_key: str, *, keep_ids: list | None = None, active: Column | None = None) -> Pruned:
    """Active parents without children, other than `keep_ids`, are removed."""
    owners = children.select(F.col(child_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    spare = F.col(key).isin(keep_ids) if keep_ids else F.lit(False)
    open_rows = parents.where(~spare & (F.lit(True) if active is None else active))
    removed = open_rows.join(owners, key, "left_anti")
    return Pruned(parents.join(removed.select(key), key, "left_anti"), removed)


class Coverage(NamedTuple):
    detail: DataFrame
    summary: DataFrame


def authority_coverage(works: DataFrame, authority: DataFrame, known_ids: DataFrame, *, key: str = "name_key") -> Coverage:
    """Per work resolved (one VIAF id among its candidates), ambiguous, not_found or not_applicable,
    and whether that identity is known already; and counts of both."""
    per_key = authority.where(F.col(key) != "").groupBy(key).agg(F.collect_set("viaf_id").alias("viafs"), F.count("*").alias("candidates"))
    joined = works.join(per_key, key, "left")
    status = (
        F.when(F.coalesce(F.col(key), F.lit("")).isin("", "anonymous"), "not_applicable")
        .when(F.coalesce("candidates", F.lit(0)) == 0, "not_found")
        .when(F.size("viafs") == 1, "resolved")
        .otherwise("ambiguous")
    )
    detail = joined.withColumn("status", status).withColumn("viaf_id", F.when(F.col("status") == "resolved", F.get("viafs", F.lit(0)))).drop("viafs")
    known = known_ids.select("viaf_id").distinct().withColumn("known", F.lit(True))
    detail = detail.join(known, "viaf_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return Coverage(detail, detail.groupBy("status", "known").agg(F.count("*").alias("n")))
