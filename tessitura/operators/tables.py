"""Upserts, bulk edits, child lists, first and last rows, pages. Inputs are never changed: results are
new DataFrames, and the caller swaps the directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import strip

Order = list[str | Column]

#: The columns that `with_position` adds: file, then row in it.
POSITION: Order = ["_file", "_row"]


def with_position(table: DataFrame) -> DataFrame:
    """A table read from Parquet, with each row's place in it. As the last columns of an order, POSITION gives rows
    that are equal in the others the order they were written in, however tasks read and exchange them."""
    return table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def first_per_key(df: DataFrame, key: list[str], order: Order) -> DataFrame:
    """The first row of each key in the given order (make it unique)."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def last_per_key(df: DataFrame, key: list[str], order: list[str], ties: Order | None = None) -> DataFrame:
    """The last row of each key; of rows equal in `order` the first by `ties`."""
    return first_per_key(df, key, [*(F.desc(c) for c in order), *(ties or [])])


def best_per_key(df: DataFrame, key: list[str], score: str, tiebreak: list[str]) -> DataFrame:
    """The row of highest score; ties to the first in the order of `tiebreak`."""
    return first_per_key(df, key, [F.desc_nulls_last(score), *tiebreak])


def pick_spelling(df: DataFrame, key: list[str], spelling: str) -> DataFrame:
    """The most frequent, then longest, then least spelling of each key, with its count."""
    counts = df.groupBy(*key, spelling).agg(F.count("*").alias("n"))
    return first_per_key(counts, key, [F.desc("n"), F.desc(F.length(spelling)), spelling])


def flag_conflicts(df: DataFrame, value: list[str], owner: str, order: Order) -> DataFrame:
    """Adds `first_owner` of a value in the given order (make it unique), and whether this row's owner is another."""
    first = F.first(owner).over(Window.partitionBy(*value).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("first_owner", first).withColumn("conflict", F.col("first_owner") != F.col(owner))


def page(df: DataFrame, order: Order, limit: int, offset: int = 0) -> DataFrame:
    """An ordered page. The order ends with a unique key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_desc(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Newest first."""
    return page(df, [F.desc(c) for c in order], limit, offset)


def top_groups(df: DataFrame, key: list[str], agg: Column, n: int) -> DataFrame:
    """The n groups of highest aggregate; ties by key."""
    counted = df.groupBy(*key).agg(agg.alias("value"))
    return counted.orderBy(F.desc("value"), *key).limit(n)


def keyset(df: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The next n rows after a key."""
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, rules: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Rows of both by key. Columns that `new` has overwrite, the others stay; a rule (old, new) ->
    value says otherwise for a column. `new` has each key once."""
    rules = rules or {}
    a, b = old.withColumn("_a", F.lit(True)), new.withColumn("_b", F.lit(True))
    for c in keys:
        b = b.withColumnRenamed(c, f"_k_{c}")
    for c in set(new.columns) - set(keys):
        b = b.withColumnRenamed(c, f"_n_{c}")
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    joined = a.join(b, on, "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.when(F.col("_a"), F.col(c)).otherwise(F.col(f"_k_{c}")).alias(c))
        elif c in new.columns:
            both = rules[c](F.col(c), F.col(f"_n_{c}")) if c in rules else F.col(f"_n_{c}")
            out.append(F.when(F.col("_b") & F.col("_a"), both).when(F.col("_b"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def keep_flag(old: Column, new: Column) -> Column:
    """A rule for `upsert`: a flag that is set stays set."""
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old`, and the rows of `new` whose key it lacks. `new` has each key once."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_list(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Child rows (key, value), with the lists of the keys in `new` (key, array `value`) replaced:
    trimmed, without blanks, each value once, in order (`position`)."""
    cleaned = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(value), F.array().cast("array<string>")), strip), lambda v: v.isNotNull() & (v != "")))
    added = new.select(key, F.posexplode(cleaned).alias("position", value))
    kept = old.join(new.select(key).distinct(), key, "left_anti").select(key, "position", value)
    return kept.unionByName(added.select(key, "position", value))


def bulk_set(df: DataFrame, edits: DataFrame, key: str, col: str) -> DataFrame:
    """Sets `col` for the keys in `edits` (key, col); a null there leaves the old value."""
    new = edits.select(key, F.col(col).alias("_new"))
    return df.join(new, key, "left").withColumn(col, F.coalesce("_new", col)).drop("_new").select(*df.columns)


def edit_rows(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """X11: bulk edits. Non-null values of the columns of `edits` replace those of the row with its key."""
    for c in edits.columns:
        if c != key:
            df = bulk_set(df, edits, key, c)
    return df


def manifest_diff(csv: DataFrame, index: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """One row: csv, entries and files counts, missing and extra keys, and whether all agree."""
    mark = lambda df, name: df.select(key).distinct().withColumn("side", F.lit(name))
    sides = mark(csv, "csv").unionByName(mark(index, "index")).unionByName(mark(disk, "disk"))
    per_key = sides.groupBy(key).agg(*(F.max((F.col("side") == s).cast("int")).alias(s) for s in ("csv", "index", "disk")))
    sums = per_key.agg(
        F.coalesce(F.sum("csv"), F.lit(0)).alias("csv"),
        F.coalesce(F.sum("index"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("disk"), F.lit(0)).alias("files"),
        F.count_if((F.col("index") == 1) & (F.col("disk") == 0)).alias("missing"),
        F.count_if((F.col("index") == 0) & (F.col("disk") == 1)).alias("extra"),
    )
    agree = (F.col("csv") == F.col("entries")) & (F.col("entries") == F.col("files")) & (F.col("missing") == 0) & (F.col("extra") == 0)
    return sums.withColumn("ok", agree)
