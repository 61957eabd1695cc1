"""Vote intake and incremental matching as streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans import identity
from ..sources.publish import TableSet
from ..sources.staging import stage, unstage


def vote_stream(
    stream: DataFrame, items: DataFrame, *, user: str = "user_id", item: str = "work_id", vote: str = "vote", ts: str = "voted_at", lo: int = 1, hi: int = 5, watermark: str = "2 days"
) -> DataFrame:
    """ST1: votes in range for known items, the first of a user, item and UTC day. The watermark delay
    must be over a day, as the key is a day; later votes are dropped, and Spark counts them."""
    known = items.select(item).distinct()
    fair = stream.where(F.col(vote).between(lo, hi)).withWatermark(ts, watermark).join(known, item, "left_semi")
    return fair.withColumn("vote_day", F.to_date(ts)).dropDuplicatesWithinWatermark([user, item, "vote_day"])


def take_votes(accepted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Accepted votes as files under `path`, each once, whatever runs again: a later run with the same
    checkpoint goes on where the last one stopped, with the votes it remembers."""
    return accepted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_votes(query: StreamingQuery) -> int:
    """How many votes a finished run of `take_votes` dropped because they came after the watermark."""
    progress = query.recentProgress
    if len(progress) >= int(query._jsq.sparkSession().conf().get("spark.sql.streaming.numRecentProgressUpdates")):
        raise RuntimeError("the run has more batches than its progress is kept for")
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def count_votes(votes: DataFrame, path: str, checkpoint: str, *, item: str = "work_id", vote: str = "vote") -> StreamingQuery:
    """ST1: running count and sum per item of a stream of accepted votes, kept as state: the rows are as
    many as the items, and a vote is added to its item once. Each batch writes the new totals of the
    items that it changed under its batch id; one that runs again overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    totals = votes.groupBy(item).agg(F.count("*").alias("n"), F.sum(vote).alias("s"))
    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(accepted: DataFrame, path: str, checkpoint: str, *, item: str = "work_id", vote: str = "vote") -> StreamingQuery:
    """Takes the votes that are there and then counts them: `take_votes` and `count_votes` in turn, as
    totals that change can't follow the first-vote rule in one stream."""
    take_votes(accepted, f"{path}/accepted", f"{checkpoint}/accepted").awaitTermination()
    votes = accepted.sparkSession.readStream.schema(accepted.schema).parquet(f"{path}/accepted")
    return count_votes(votes, f"{path}/totals", f"{checkpoint}/totals", item=item, vote=vote)


def total_counts(spark: SparkSession, path: str, *, item: str = "work_id") -> DataFrame:
    """The newest totals of `running_counts`."""
    changes = spark.read.parquet(f"{path}/totals").groupBy(item).agg(F.max_by(F.struct("n", "s"), "batch").alias("last"))
    return changes.select(item, "last.n", "last.s")


def run_incremental_match(spark: SparkSession, source: str, schema: StructType, state_dir: str, match: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """New files under `source` go through `match` (batch -> outcomes); outcomes are written per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{state_dir}/outcomes/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()


#: The tables of a set that matching reads and writes, and what the names of its outcomes begin with.
MASTER = ("composers", "aliases", "identifiers")
OUTCOMES = "outcomes-"


def match_stream(stream: DataFrame, tables: TableSet, checkpoint: str, *, published: Callable[[int], None] | None = None) -> StreamingQuery:
    """ST2: works with the resolver's answer (id, title, composer, composer_id, status, candidates) as a
    stream through E7, against the entities of a published set.

    A batch is one publication: its outcomes and the entities, aliases and identifiers that it made become
    visible together, and the next batch meets them. The publication has the batch's id, so a batch that
    runs again after a failure finds itself published and writes nothing, or, if it failed before, has
    left nothing. Works with an outcome are left out. `published` is called after each publication."""

    def write(batch: DataFrame, batch_id: int) -> None:
        run_id = f"match-{batch_id}"
        if tables.version_of(run_id) is None:
            before = tables.version()
            rows = stage(batch)
            master = tables.read_all(before)
            done = [master[n].select("work_id") for n in master if n.startswith(OUTCOMES)]
            seen = reduce(DataFrame.unionByName, done) if done else None
            answers = rows.where("status is not null").select(F.col("id").alias("work_id"), "status", "candidates")
            found = identity.match_works(rows.drop("status", "candidates"), answers, *(master[n] for n in MASTER), seen)
            tables.publish(
                {"composers": found.composers, "aliases": found.aliases, "identifiers": found.identifiers, f"{OUTCOMES}{batch_id:09d}": found.outcomes},
                run_id=run_id, expected=before,
            )
            unstage(rows)
        if published is not None:
            published(batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_outcomes(tables: TableSet) -> DataFrame:
    """All outcomes of a set: work_id, outcome, composer_id."""
    return reduce(DataFrame.unionByName, [df for name, df in tables.read_all().items() if name.startswith(OUTCOMES)])
