"""Ranking signals computed from evidence graphs and change logs, instead of given ones. Measures are ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.relational import numbered_by_range
from loomstead.sources.shared import materialize

#: Reachable sets up to this size are counted exactly, larger ones by sketches of 2^SKETCH registers, whose standard
#: error is 1.04 / sqrt(2^SKETCH), 1.6 %.
EXACT, SKETCH = 64, 12
#: Steps of a power iteration that go into one written table.
UNROLLED = 4


def downstream(edges: DataFrame, exact: int = EXACT) -> DataFrame:
    """node, impact, is_exact of all nodes of edges (source, target): how many nodes it reaches, itself if on a cycle.

    Each node holds what it reaches as a set while that has at most `exact` nodes. In a round the reach of sets doubles:
    each takes in those of its nodes that the last round brought, so rounds are as many as the logarithm of the longest
    way. Only nodes that reach more have a sketch, which takes in those of such targets until nothing changes. Unions may
    take in the same twice, so cycles need no components. A node with more than `exact` targets needs no set, so no row
    grows beyond exact^2 entries. Joins are by shuffles: no table passes through the driver.
    """
    edges = materialize(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
    # sets of hubs are cut off by their number of targets before they are collected
    hub = F.count("*") > exact
    few = edges.join(edges.groupBy("source").agg(hub.alias("_hub")).where("NOT _hub").hint("merge"), "source", "left_semi")
    first = few.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("set"))
    # set: null beyond `exact`; fresh: what the last round brought
    sources = edges.select(F.col("source").alias("node")).distinct()
    state = materialize(sources.join(first.hint("merge"), "node", "left").select("node", "set", F.col("set").alias("fresh")))
    while not state.where("size(fresh) > 0").isEmpty():
        asked = state.where("size(fresh) > 0").select("node", F.explode("fresh").alias("_u"))
        met = asked.join(state.select(F.col("node").alias("_u"), F.col("set").alias("_s")).hint("merge"), "_u")
        big = F.max(F.col("_s").isNull())
        sets = met.groupBy("node").agg(F.when(~big, F.array_distinct(F.flatten(F.collect_list("_s")))).alias("_set"), big.alias("_big"))
        union = F.when(F.coalesce("_big", F.lit(False)), None).when(F.col("_set").isNull(), F.col("set")).otherwise(F.array_union("set", "_set"))
        taken = state.join(sets.hint("merge"), "node", "left").select("node", F.col("set").alias("_was"), F.when(F.size(union) <= exact, union).alias("set"))
        state = materialize(taken.select("node", "set", F.array_except("set", "_was").alias("fresh")))
    return _counted(edges, state.select("node", "set"))


def _counted(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The same, given the sets (node, set; null beyond what is exact) of all sources of edges."""
    big = materialize(sets.where("set IS NULL").select("node"))
    leading = edges.join(big.select(F.col("node").alias("source")).hint("merge"), "source", "left_semi")
    reached = leading.join(sets.select(F.col("node").alias("target"), "set").hint("merge"), "target", "left")
    # what a target without targets reaches is itself
    own = reached.select(F.col("source").alias("node"), F.explode(F.concat(F.array("target"), F.coalesce("set", F.array().cast(sets.schema["set"].dataType)))).alias("target"))
    state = materialize(own.groupBy("node").agg(F.hll_sketch_agg("target", F.lit(SKETCH)).alias("sketch")).withColumn("moved", F.lit(True)))
    among = materialize(leading.join(big.select(F.col("node").alias("target")).hint("merge"), "target", "left_semi"))
    while not state.where("moved").isEmpty():
        # only what has just grown is sent on
        grown = state.where("moved").select(F.col("node").alias("target"), "sketch")
        sketches = among.join(grown.hint("merge"), "target").groupBy(F.col("source").alias("node")).agg(F.hll_union_agg("sketch").alias("_sketch"))
        sketch = F.when(F.col("_sketch").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "_sketch"))
        taken = state.join(sketches.hint("merge"), "node", "left").select("node", F.col("sketch").alias("_old"), sketch.alias("sketch"))
        state = materialize(taken.select("node", "sketch", (F.hll_sketch_estimate("sketch") != F.hll_sketch_estimate("_old")).alias("moved")))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    known = nodes.join(sets.hint("merge"), "node", "left").join(state.select("node", "sketch").hint("merge"), "node", "left")
    impact = F.when(F.col("sketch").isNotNull(), F.hll_sketch_estimate("sketch")).when(F.col("set").isNotNull(), F.size("set")).otherwise(F.lit(0))
    return known.select("node", impact.cast("long").alias("impact"), F.col("sketch").isNull().alias("is_exact"))


def centrality(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, unrolled: int = UNROLLED) -> DataFrame:
    """node, centrality (mean 1): the stationary share of a walk over edges (source, target), which jumps at 1 - damping.

    Nodes without targets jump always: what they hold goes to all alike, so it only scales the result, and is left out
    until the end. Power iteration until the changes of a step sum up to tolerance at most over all nodes, however many, or
    no longer fall, as only rounding is left of them; `unrolled` steps are one written table. Shares arrive by partial
    sums, so a hub's edges in are added up where they lie, and no table passes through the driver. Repeated edges count once;
    null ends are left out.
    """
    edges = materialize(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
    degree = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    nodes = materialize(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(degree.hint("merge"), "node", "left"))
    state, n, before = nodes.select("node", "degree", F.lit(1.0).alias("held"), F.lit(0.0).alias("_was")), nodes.count(), float("inf")
    while True:
        for _ in range(unrolled):
            sent = edges.join(state.where("degree IS NOT NULL").select(F.col("node").alias("source"), (F.col("held") / F.col("degree")).alias("_s")).hint("merge"), "source")
            arrived = sent.groupBy(F.col("target").alias("node")).agg(F.sum("_s").alias("_in"))
            state = state.join(arrived.hint("merge"), "node", "left").select("node", "degree", (1 + damping * F.coalesce("_in", F.lit(0.0))).alias("held"), F.col("held").alias("_was"))
        state = materialize(state)
        sums = state.agg(F.sum("held").alias("held"), F.sum(F.abs(F.col("held") - F.col("_was"))).alias("moved")).first()
        was, before = before, sums["moved"] or 0.0
        if before <= tolerance or before >= was:
            return state.select("node", (F.col("held") * F.lit(n / (sums["held"] or 1.0))).alias("centrality"))


def churn(changes: DataFrame, node: str, at: str, now: Column, half_life_days: float) -> DataFrame:
    """node, churn: changes counted with a weight that halves every half_life_days before `now`; later ones count as now.

    Weights are relative to now, so partial sums of any split of the log add up.
    """
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 86_400e6)
    return changes.where(F.col(node).isNotNull() & F.col(at).isNotNull()).groupBy(node).agg(F.sum(F.pow(F.lit(0.5), age / half_life_days)).alias("churn"))


def by_rank(df: DataFrame, value: str, ident: str, name: str) -> DataFrame:
    """df with name: 0 to 999, the share of rows that are smaller (ties by ident), so one huge value says no more than first."""
    numbered = numbered_by_range(df, [], F.asc(value), F.asc(ident), name="_i", total="_n")
    return numbered.withColumn(name, ((F.col("_i") - 1) * 999 / F.greatest(F.col("_n") - 1, F.lit(1))).cast("decimal(6,3)")).drop("_i", "_n")
