"""Incremental analysis: differences between snapshots by hash, and what they make stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str = "stable_key", value: str = "hash") -> DataFrame:
    """key and change (added, removed, changed, unchanged) of two snapshots; one shuffle of each side."""
    a, b = old.select(F.col(key), F.col(value).alias("_a"), F.lit(True).alias("_o")), new.select(F.col(key), F.col(value).alias("_b"), F.lit(True).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def stale_receipts(receipts: DataFrame, nodes: DataFrame) -> DataFrame:
    """receipts with stale: no node of that key has that hash. Nodes of several snapshots multiply no receipt."""
    now = nodes.select(F.col("stable_key").alias("_key"), F.col("hash").alias("_now")).distinct().withColumn("_there", F.lit(True))
    known = receipts.join(now, (F.col("node_stable_key") == F.col("_key")) & F.col("node_hash").eqNullSafe(F.col("_now")), "left")
    return known.withColumn("stale", F.col("_there").isNull()).drop("_key", "_now", "_there")


def propagate(changed: DataFrame, steps: DataFrame, sections: DataFrame) -> DataFrame:
    """section_id of the sections of workflows with a step on a changed node; the unchanged aren't touched.

    changed (node_id), steps (workflow_id, node_id), sections (section_id, workflow_id): the link is ours.
    """
    workflows = steps.join(changed, "node_id", "left_semi").select("workflow_id").distinct()
    return sections.join(workflows, "workflow_id", "left_semi").select("section_id").distinct()


def changed_files(flags: DataFrame, key: str, file: str) -> DataFrame:
    """key and changed_files: the distinct files, sorted."""
    return flags.groupBy(key).agg(F.array_sort(F.collect_set(file)).alias("changed_files"))


def doc_health(links: DataFrame, changed: DataFrame) -> DataFrame:
    """doc_path with the numbers of its links and of those to changed nodes, and whether it is healthy."""
    marked = links.join(changed.select(F.col("node_id").alias("linked_node_id")).distinct().withColumn("_c", F.lit(1)), "linked_node_id", "left")
    counted = marked.groupBy("doc_path").agg(F.count("*").alias("links"), F.count("_c").alias("changed_links"))
    return counted.withColumn("health", F.when(F.col("changed_links") == 0, "ok").otherwise("stale"))


def rollup(nodes: DataFrame, key: str, kind: Column, kinds: dict[str, str]) -> DataFrame:
    """Counters of a snapshot by the kind of node, in one aggregate."""
    return nodes.groupBy(key).agg(*[F.count_if(kind == value).cast("int").alias(name) for name, value in kinds.items()])


def confidence(receipts: Column, low: int = 0, medium: int = 2) -> Column:
    """low without receipts, or without a number of them; the other threshold is ours."""
    receipts = F.coalesce(receipts, F.lit(0))
    return F.when(receipts <= low, "low").when(receipts <= medium, "medium").otherwise("high")
