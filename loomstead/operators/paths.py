"""Paths through evidence graphs from entrypoints to side effects, and the workflows and steps that they make.

Nodes are of any one type, edges (source, target) may be repeated and may run in cycles. Null ends join with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators.graph import reach
from loomstead.sources.shared import materialize


def discover(edges: DataFrame, starts: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """start, target, path: all paths without cycles of at most `depth` edges from starts to targets (node each).

    A backward pass gives each node its distance to the nearest target; only edges that can still arrive are followed,
    so a hub's other edges are gone before any path meets them. Every step is written, and carries the paths that
    arrive later; a path that arrives may go on to another target. A start that is a target is no path.
    """
    backward = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    near = materialize(reach(backward, targets, depth).select("node", F.col("depth").alias("left"), (F.col("depth") == 0).alias("is_target")))
    ahead = near.select(F.col("node").alias("target"), "left", "is_target")
    useful = materialize(edges.select("source", "target").distinct().join(ahead, "target").join(near.select(F.col("node").alias("source")), "source", "left_semi"))
    begun = starts.select("node").distinct().join(near.select("node"), "node", "left_semi")
    front, found = begun.select(F.col("node").alias("start"), "node", F.array("node").alias("path")), None
    for d in range(1, depth + 1):
        further = front.join(useful.where(F.col("left") <= depth - d), F.col("node") == F.col("source")).where(~F.array_contains("path", F.col("target")))
        front = materialize(further.select("start", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"), "is_target"))
        if front.isEmpty():
            break
        arrived = front.where("is_target").select("start", F.col("node").alias("target"), "path")
        found, front = arrived if found is None else found.unionByName(arrived), front.drop("is_target")
    return found if found is not None else front.select("start", F.col("node").alias("target"), "path").limit(0)


def maximal(paths: DataFrame) -> DataFrame:
    """The paths that are no run of nodes inside a longer one.

    Each path gives the runs that it holds, which are joined with the paths by the run itself: as many rows as a path
    has pairs of nodes, and no path is compared with all others.
    """
    size = F.size("path")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda a: F.transform(F.sequence(a + 1, size), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    proper = F.filter(spans, lambda s: s["b"] - s["a"] + 1 < size)
    inside = paths.where(size > 2).select("path", F.explode(proper).alias("_s")).select(F.slice("path", F.col("_s.a"), F.col("_s.b") - F.col("_s.a") + 1).alias("path")).distinct()
    return paths.join(inside, "path", "left_anti")


def workflows(paths: DataFrame) -> DataFrame:
    """workflow_id, start, target, path of the maximal paths; the id follows from the path."""
    return maximal(paths).select(F.sha2(F.array_join(F.transform("path", lambda n: n.cast("string")), "\n"), 256).alias("workflow_id"), "start", "target", "path")


def workflow_steps(flows: DataFrame) -> DataFrame:
    """workflow_id, step_order (from 1), node of workflows; (workflow_id, step_order) is unique."""
    return flows.select("workflow_id", F.posexplode("path").alias("_p", "node")).select("workflow_id", (F.col("_p") + 1).alias("step_order"), "node")
