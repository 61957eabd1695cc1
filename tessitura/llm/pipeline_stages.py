"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents with what the stage decided.

All columns of the documents, whatever their names, pass through every stage; the last one adds the
words that the mix takes. A stage decides on the rows that it is given. Rows with a null id and
different texts under one id are documents of their own; rows that are equal in all columns are
copies of each other. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, mixing, secret_scan
from ._common import Stages, fresh, sized_broadcast

#: Columns that the last stage adds.
MIXED = ["size", "source_size", "target", "taken", "rate"]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that name their language; drops those whose text has none (`und`)."""
    model, seen = language_id.train_language_model(docs), fresh(docs, "seen")
    found = language_id.identify_language(docs, model, into=seen)
    return found.where(F.col(f"{seen}.lang_pred") != "und").drop(seen)


def row_key(docs: DataFrame) -> Column:
    """A text that orders rows by doc_id, null last, and names a row by all its columns."""
    whole = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), {"ignoreNullFields": "false"}), 256)
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0")
    return F.concat(F.coalesce(place, F.lit("~")), F.lit("-"), whole)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word shingles of five, similarity of 0.8 or more) the document
    of least id stays; of several texts under that id, one. Documents without words stay."""
    stages, key = Stages(spark), fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs))
    found = stages.write(
        jaccard_join.jaccard_components(keyed.select(key, "text"), doc_id=key, words=5, percent=80)
        .where("class_id is not null").groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    )
    others = stages.write(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)))
    kept = keyed.join(sized_broadcast(others, row_bytes=128), key, "left_anti")
    repeated = stages.write(found.where("doc_id = component_id and n > 1").select(F.col("doc_id").alias(key)))
    n = repeated.count()
    if not n:
        return kept.drop(key)
    copies = sized_broadcast(repeated, n, row_bytes=128)
    once = kept.join(copies, key, "left_semi").dropDuplicates([key])
    return kept.join(copies, key, "left_anti").unionByName(once).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    benchmark, seen = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), fresh(docs, "seen")
    found = decontaminate.mark_contaminated(docs, benchmark, into=seen)
    return found.where(F.size(f"{seen}.starts") == 0).drop(seen)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows where a text has changed."""
    model, seen = secret_scan.train_secret_model(docs), fresh(docs, "seen")
    found = secret_scan.scan_secrets(docs, model, into=seen)
    text = F.col(f"{seen}.redacted")
    n_chars = F.when(F.size(f"{seen}.starts") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": n_chars, "text": text}).drop(seen)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with how many words of each the mix takes (0: it isn't in the mix)."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    mixed = mixing.mix_sources(
        docs.withColumnsRenamed(inner), doc_id=inner["doc_id"], text=inner["text"], source=inner["source"], carry=tuple(v for c, v in inner.items() if c not in ("doc_id", "source"))
    )
    return mixed.select(
        *(F.col(c if c in ("doc_id", "source") else v).alias(c) for c, v in inner.items()), *(F.col(c).alias(fresh(docs, c)) for c in MIXED)
    )
