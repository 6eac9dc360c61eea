"""Sources and sinks: Parquet and JDBC tables with declared schemas, landed REST answers, repository files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomstead.schemas import BENCH, domain_schema
from loomstead.sources.shared import materialize

#: Fields of the answers that are read; others are ignored.
INSTALLATIONS = "id long, account struct<login:string,type:string>, repository_selection string"
REPOS = "id long, name string, full_name string, private boolean, default_branch string, owner struct<login:string>"
BRANCHES = "name string, commit struct<sha:string>, protected boolean"


def bench_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A benchmark table; the schema is declared, so no file is opened for it."""
    return spark.read.schema(BENCH[table]).parquet(f"{sf_dir}/{table}.parquet")


def domain_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(domain_schema(table)).parquet(f"{folder}/{table}")


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """A table behind JDBC; with a numeric key and its bounds it is read by so many connections at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def query(spark: SparkSession, text: str, **binds) -> DataFrame:
    """A SQL statement with named parameters (:name), which are never pasted into its text."""
    return spark.sql(text, args=binds)


def landed(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Rows of landed REST answers (JSON): of the array `field`, or of the answers themselves."""
    if field is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    kind = StructType.fromDDL(f"{field} array<struct<{StructType.fromDDL(schema).simpleString()[7:-1]}>>")
    return spark.read.schema(kind).json(path, multiLine=True).select(F.inline(field))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of an installation, with the owner's login as owner."""
    return landed(spark, path, REPOS, "repositories").select("id", "name", "full_name", "private", "default_branch", F.col("owner.login").alias("owner"))


def repository_files(spark: SparkSession, path: str) -> DataFrame:
    """The inventory of a repository's unpacked archive: path, bytes, hash. Contents stay where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))


def insert_returning(rows: DataFrame, path: str) -> DataFrame:
    """Append rows to a Parquet table and return what was written: times and ids are made once."""
    made = materialize(rows)
    made.write.mode("append").parquet(path)
    return made


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """A column `json` with one object a row, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def from_json(df: DataFrame, table: str) -> DataFrame:
    """Rows of a domain table from a column `json`."""
    return df.select(F.inline(F.array(F.from_json("json", domain_schema(table)))))
