"""Tables in the folder that driver and executors share, which cut off lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that this thread has made in the shared folder.
_made = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session that names none gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, destination: str | None = None) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends here, and lost executors lose nothing.

    Tables go into the shared folder and are deleted when the driver's JVM ends, or stay in the folder `destination`.
    """
    spark = df.sparkSession
    path = destination or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not destination:
        at, files = _located(spark, path)
        files.deleteOnExit(at)
        _made.paths = [*getattr(_made, "paths", []), path]
    return spark.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, for several tables; deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    at, files = _located(spark, path)
    files.mkdirs(at)  # only what exists is deleted at the end
    files.deleteOnExit(at)
    return path


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, as a table; tables that this thread makes on the way are deleted once it is written."""
    before = getattr(_made, "paths", [])
    table = materialize(make())
    *passing, last = _made.paths[len(before) :]
    for path in passing:
        at, files = _located(table.sparkSession, path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)
    _made.paths = [*before, last]
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread makes inside are deleted at the end, whether or not it succeeds."""
    before = getattr(_made, "paths", [])
    try:
        yield
    finally:
        for path in getattr(_made, "paths", [])[len(before) :]:
            at, files = _located(spark, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)
        _made.paths = before


def _located(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Hadoop knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
