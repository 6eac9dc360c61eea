"""Landed listings over the benchmark tables: nations stand in for owners, customers for repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.plans.base import Registry, Tables
from loomstead.sources.pages import land, pages
from loomstead.sources.shared import fresh_folder

query = Registry()
#: Keys that one page spans.
PAGE = 2000


@query(f"""SELECT CAST(c_nationkey AS VARCHAR) AS owner, c_custkey AS id, c_name AS name,
 CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey // {PAGE}) AS VARCHAR) AS page,
 CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey // {PAGE} ORDER BY c_custkey) - 1 AS INT) AS position FROM customer""")
def landed_listing(t: Tables) -> DataFrame:
    """Each nation's customers, landed as a chain of pages and read back along their links."""
    owner, span = F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / PAGE)
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    # a page has at most PAGE keys; the windows below have a row for each page
    filled = t.customer.groupBy(owner.alias("owner"), span.alias("_span")).agg(F.array_sort(F.collect_list(item)).alias("repositories"))
    chain = Window.partitionBy("owner").orderBy("_span")
    number = F.row_number().over(chain)
    linked = filled.withColumns({"page": number.cast("string"), "next": F.when(F.lead("_span").over(chain).isNotNull(), (number + 1).cast("string"))})
    folder = fresh_folder(t.spark)
    land(linked.select("owner", "page", F.to_json(F.struct("next", "repositories")).alias("body")), folder)
    read = pages(t.spark, folder, field="repositories")
    return read.select("owner", "page", "position", F.from_json("item", "id long, name string").alias("i")).select("owner", "i.id", "i.name", "page", "position")
