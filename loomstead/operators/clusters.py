"""Clusters of modules by their dependencies: communities of a weighted graph by moves that gain modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.sources.shared import materialize


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """a, b (a <= b), weight: how many edges (source, target) run between two modules (node, module), either way."""
    of = lambda end: modules.select(F.col("node").alias(end), F.col("module").alias(f"_{end}"))
    ends = edges.join(of("source"), "source").join(of("target"), "target")
    return ends.groupBy(F.least("_source", "_target").alias("a"), F.greatest("_source", "_target").alias("b")).agg(F.count("*").cast("double").alias("weight"))


def modularity(both: DataFrame, labels: DataFrame, total: float) -> float:
    """The share of weight inside communities less what chance would put there. both has each edge in both directions."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
    placed = both.join(of("a"), "a").join(of("b"), "b")
    sums = placed.groupBy("_a").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight"))).alias("inside"))
    return sums.agg((F.sum(F.coalesce("inside", F.lit(0.0))) / total - F.sum((F.col("k") / total) * (F.col("k") / total))).alias("q")).first()["q"] or 0.0


def communities(weights: DataFrame, patience: int = 4) -> tuple[DataFrame, float]:
    """node, label (its smallest node) of the ends of weights (a, b, weight), and the modularity.

    Each node starts alone. In a round those that its hash picks, half of all, move to the neighbouring community with
    the largest gain (ties: the smallest label), or stay. The best labels are kept; after `patience` rounds that don't
    better them it ends, so modularity is never below that of nodes alone. Sums are of partial sums, and a row holds
    one edge, one node or one community, never a module's members. Null ends and weights of 0 or less are left out.
    """
    there = weights.where("a IS NOT NULL AND b IS NOT NULL AND weight > 0")
    # an edge of a node with itself counts twice, as others do
    both = materialize(there.select("a", "b", "weight").unionAll(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    degrees = materialize(both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")))
    total = degrees.agg(F.sum("k")).first()[0] or 0.0
    labels = materialize(degrees.select("node", F.col("node").alias("label"), "k"))
    best, quality, round_, idle = labels, modularity(both, labels, total) if total else 0.0, 0, 0
    while total and idle < patience:
        round_ += 1
        near = both.where("a <> b").join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        own = labels.select("node", "label", F.lit(0.0).alias("w"))
        options = near.unionByName(own).groupBy("node", "label").agg(F.sum("w").alias("w"))
        held = labels.groupBy("label").agg(F.sum("k").alias("_held"))
        me = labels.select("node", F.col("label").alias("_mine"), "k")
        mine = F.col("label") == F.col("_mine")
        gain = F.col("w") - F.col("k") * (F.col("_held") - F.when(mine, F.col("k")).otherwise(0.0)) / total
        judged = options.join(held, "label").join(me, "node").withColumn("_gain", F.round(gain, 9))
        # the largest gain; the own community before others that are as good
        chosen = judged.groupBy("node").agg(F.min(F.struct((-F.col("_gain")).alias("g"), (~mine).alias("other"), "label"))["label"].alias("_to"))
        picked = F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(2)) == 0
        labels = materialize(labels.join(chosen, "node").select("node", F.when(picked, F.col("_to")).otherwise(F.col("label")).alias("label"), "k"))
        now = modularity(both, labels, total)
        best, quality, idle = (labels, now, 0) if now > quality + 1e-12 else (best, quality, idle + 1)
    named = best.groupBy("label").agg(F.min("node").alias("_first"))
    return best.join(named, "label").select("node", F.col("_first").alias("label")), quality
