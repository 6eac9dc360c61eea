"""The planned job lifecycle as a stream: queued jobs are claimed, worked on with retries and recorded.

The queue is a folder of Parquet files; a checkpoint remembers what was claimed, so a job is claimed once however
often the worker stops; a batch that was cut short is claimed again. Its log is append-only: a row for each claim and
each result of a job, of which the last counts. A job that `work` gives no result for has failed at that attempt. Tables
of a batch are deleted at its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.schemas import domain_schema
from loomstead.sources.shared import materialize, scratch

LOG = "id string, batch long, attempts int, step int, status string, progress_pct int, error_message string"


def run(spark: SparkSession, queue: str, log: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, retries: int = 3) -> None:
    """Work on all queued jobs there are. work gets claimed jobs and returns (id, error), error null if done."""

    def record(rows: DataFrame, batch_id: int, attempt: int, step: int) -> None:
        progress = F.when(F.col("status") == "complete", 100).otherwise(0)
        rows.select("id", F.lit(batch_id).cast("long").alias("batch"), F.lit(attempt).alias("attempts"), F.lit(step).alias("step"), "status", progress.alias("progress_pct"), "error_message").write.mode("append").parquet(log)

    def claim(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            attempts(batch, batch_id)

    def attempts(batch: DataFrame, batch_id: int) -> None:
        open_jobs = materialize(batch.where("status = 'queued'"))
        for attempt in range(1, retries + 1):
            record(open_jobs.select("id", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_message")), batch_id, attempt, 0)
            given = work(open_jobs).groupBy("id").agg(F.max("error").alias("error"), F.lit(True).alias("_given"))
            error = F.when(F.col("_given").isNull(), "no result").otherwise(F.col("error"))
            done = materialize(open_jobs.select("id").join(given, "id", "left").select("id", error.alias("error")))
            status = F.when(F.col("error").isNull(), "complete").when(F.lit(attempt == retries), "failed").otherwise("queued")
            record(done.select("id", status.alias("status"), F.col("error").alias("error_message")), batch_id, attempt, 1)
            open_jobs = materialize(open_jobs.join(done.where("error IS NOT NULL"), "id", "left_semi"))
            if open_jobs.isEmpty():
                break

    stream = spark.readStream.schema(domain_schema("analysis_jobs")).parquet(queue)
    stream.writeStream.foreachBatch(claim).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, log: str) -> DataFrame:
    """The last record of each job; a batch that ran again replaces what it recorded before."""
    last = F.max(F.struct("batch", "attempts", "step", "status", "progress_pct", "error_message")).alias("l")
    return spark.read.schema(LOG).parquet(log).groupBy("id").agg(last).select("id", "l.*").drop("step")
