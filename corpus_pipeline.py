"""A corpus pipeline of five stages over `documents`: language ID, near duplicates, benchmark
decontamination, secrets, mixing. Each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import pipeline_stages as s
from tessitura.llm._common import clean_shuffles, shared_dir

STAGES = [
    ("language_id", s.keep_known_language),
    ("ngram_jaccard", s.keep_one_of_each_group),
    ("decontaminate", s.drop_contaminated),
    ("secrets", s.redact_secrets),
    ("mixing", s.mix),
]

#: SQL can't express trained models and iterated balancing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with clean_shuffles(spark):
            out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}-{name}")
    return docs
