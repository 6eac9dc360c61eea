"""Evidence graphs as node and edge tables: reachability, neighbourhoods, degrees. Measures and limits are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.sources.shared import materialize


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth, path: what the start nodes (node) reach over edges (source, target), at its least depth.

    path has the nodes on the way, of several ways the first in order. Breadth first: each step joins the newest nodes
    alone, and what is known is left out, so cycles end. Steps are written, or their lineage would double each time.
    """
    edges = materialize(edges.select("source", "target").distinct())
    seen = start.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    newest = seen
    for d in range(1, depth + 1):
        step = edges.join(newest.select(F.col("node").alias("source"), "path"), "source").groupBy(F.col("target").alias("node"))
        found = step.agg(F.min(F.concat("path", F.array("target"))).alias("path"))
        newest = materialize(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "path"))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree, counted in one aggregate."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    summed = ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return summed.withColumn("degree", F.col("out_degree") + F.col("in_degree"))
