"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.sources.shared import materialize, settled

__all__ = ["BATCH_BYTES", "HOT_SHARE", "lower_ascii", "materialize", "read", "settled", "skew_safe_left_join", "small_batches"]

#: Bytes of an Arrow batch on its way to Python, one row at least; Spark's own bounds are 10,000 rows and 64 MB.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: A key is hot if it holds at least one row in so many; at most this many keys can be hot.
HOT_SHARE = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches are bounded by their bytes, so that texts in flight don't add up beside a full heap.

    A smaller bound that the session has stays. It isn't taken back, as a stage's last step runs when its result is written.
    """
    now = int(spark.conf.get(_BATCH).removesuffix("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one input table; extra columns are pruned by the scan."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def skew_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """left LEFT JOIN right on keys (equal, not null), where right has one row a key and `rows`, the key's rows in left.

    Keys with at least total / HOT_SHARE rows are at most HOT_SHARE, so their rows of right are broadcast and
    their rows of left stay where they are. All other keys are shuffled, each with few rows. `rows` is dropped.
    """
    hot = F.col(rows) * HOT_SHARE >= F.lit(max(total, HOT_SHARE))
    named = right.withColumn("_hot", hot)
    marked = left.join(F.broadcast(named.where("_hot").drop(rows)), keys, "left")
    done = marked.where(F.col("_hot"))
    rest = marked.where(F.col("_hot").isNull()).select(*[left_col for left_col in left.columns])
    cold = rest.join(named.where(~F.col("_hot")).drop(rows, "_hot"), keys, "left")
    return done.select(*cold.columns).unionByName(cold)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
