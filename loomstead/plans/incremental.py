"""Snapshots, staleness, graphs and rankings over the benchmark tables. Weights, measures and limits are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators import graph, ranking, snapshot
from loomstead.operators.relational import numbered_by_range
from loomstead.plans.base import Registry, Tables

query = Registry()
_OLD, _NEW = "ts < TIMESTAMP '2024-01-08'", "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"
_NODES = "SELECT user_id || ':' || event_type AS stable_key, CAST(count(*) AS VARCHAR) || '/' || CAST(min(event_id) AS VARCHAR) AS hash FROM events WHERE {} GROUP BY user_id, event_type"
#: Weights of the signals that parts have; the others are 0 there.
WEIGHTS = {"entrypoint_exposure": 0.4, "downstream_impact": 0.35, "structural_centrality": 0.25}
ROLES = [("frontend", "PROMO", 3), ("frontend", "ECONOMY", 1), ("backend", "ECONOMY", 2), ("backend", "STANDARD", 2)]


def _nodes(t: Tables, when: str) -> DataFrame:
    key = F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type")
    digest = F.concat(F.count("*").cast("string"), F.lit("/"), F.min("event_id").cast("string"))
    return t.events.where(F.expr(when.replace("TIMESTAMP ", "TIMESTAMP_NTZ "))).groupBy("user_id", "event_type").agg(digest.alias("hash")).select(key.alias("stable_key"), "hash")


@query(f"""SELECT coalesce(a.stable_key, b.stable_key) AS stable_key, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS change
FROM ({_NODES.format(_OLD)}) a FULL JOIN ({_NODES.format(_NEW)}) b ON a.stable_key = b.stable_key""")
def snapshot_diff(t: Tables) -> DataFrame:
    return snapshot.diff(_nodes(t, _OLD), _nodes(t, _NEW))


@query(f"SELECT a.stable_key AS node_stable_key, a.hash IS DISTINCT FROM b.hash AS stale FROM ({_NODES.format(_OLD)}) a LEFT JOIN ({_NODES.format(_NEW)}) b ON a.stable_key = b.stable_key")
def receipt_staleness(t: Tables) -> DataFrame:
    receipts = _nodes(t, _OLD).select(F.col("stable_key").alias("node_stable_key"), F.col("hash").alias("node_hash"))
    return snapshot.stale_receipts(receipts, _nodes(t, _NEW)).select("node_stable_key", "stale")


@query("""SELECT DISTINCT o_custkey AS section_id FROM orders WHERE o_orderkey IN
 (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7))""")
def stale_propagation(t: Tables) -> DataFrame:
    changed = t.part.where(F.col("p_size") == 7).select(F.col("p_partkey").alias("node_id"))
    steps = t.lineitem.select(F.col("l_orderkey").alias("workflow_id"), F.col("l_partkey").alias("node_id"))
    return snapshot.propagate(changed, steps, t.orders.select(F.col("o_custkey").alias("section_id"), F.col("o_orderkey").alias("workflow_id")))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS files FROM events GROUP BY 1")
def stale_changed_files(t: Tables) -> DataFrame:
    return snapshot.changed_files(t.events, "user_id", "event_type").select("user_id", F.array_join("changed_files", ",").alias("files"))


@query("""SELECT p_brand AS doc_path, count(*) AS links, count(*) FILTER (WHERE p_size = 7) AS changed_links, CASE WHEN count(*) FILTER (WHERE p_size = 7) = 0 THEN 'ok' ELSE 'stale' END AS health FROM part GROUP BY 1""")
def doc_health(t: Tables) -> DataFrame:
    links = t.part.select(F.col("p_brand").alias("doc_path"), F.col("p_partkey").alias("linked_node_id"))
    return snapshot.doc_health(links, t.part.where(F.col("p_size") == 7).select(F.col("p_partkey").alias("node_id")))


@query("SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS INTEGER) AS file_count, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS INTEGER) AS symbol_count, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS INTEGER) AS workflow_count FROM orders GROUP BY 1")
def snapshot_rollup_counts(t: Tables) -> DataFrame:
    return snapshot.rollup(t.orders, "o_custkey", F.col("o_orderstatus"), {"file_count": "F", "symbol_count": "O", "workflow_count": "P"})


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'low' WHEN count(o_orderkey) <= 2 THEN 'medium' ELSE 'high' END AS confidence FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def confidence_from_receipts(t: Tables) -> DataFrame:
    counts = t.orders.where(F.col("o_orderstatus") == "P").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", snapshot.confidence(F.coalesce("n", F.lit(0))).alias("confidence"))


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS bundle FROM orders GROUP BY 1")
def evidence_bundles(t: Tables) -> DataFrame:
    bundle = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    joined = F.array_join(F.transform(bundle, lambda s: F.concat(s["o_orderkey"].cast("string"), F.lit(":"), s["o_orderstatus"])), ",")
    return t.orders.groupBy("o_custkey").agg(joined.alias("bundle"))


def _edges(t: Tables) -> DataFrame:
    """Foreign keys as edges: r1 -> n3 -> c42."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    down = t.nation.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    return down.unionByName(t.customer.select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target")))


_EDGES = "SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT e.target, w.depth + 1 FROM w JOIN e ON e.source = w.node WHERE w.depth < 4)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def graph_reachability(t: Tables) -> DataFrame:
    return graph.reach(_edges(t), t.spark.createDataFrame([("r1",)], "node string"), 4).drop("path")


@query(f"""WITH RECURSIVE e AS (SELECT source, target FROM ({_EDGES}) UNION ALL SELECT target, source FROM ({_EDGES})), w AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM w JOIN e ON e.source = w.node WHERE w.depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def graph_k_hop(t: Tables) -> DataFrame:
    return graph.reach(graph.undirected(_edges(t)), t.spark.createDataFrame([("n3",)], "node string"), 2).drop("path")


@query(f"SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM ({_EDGES}) UNION ALL SELECT target, 0, 1 FROM ({_EDGES})) GROUP BY 1")
def graph_degree(t: Tables) -> DataFrame:
    return graph.degrees(_edges(t))


def _scored(t: Tables) -> DataFrame:
    """Parts with three of the signals, each in 0..999."""
    signals = {"entrypoint_exposure": F.col("p_size") * 10, "downstream_impact": F.col("p_partkey") % 997, "structural_centrality": (F.col("p_partkey") * 7) % 500}
    return t.part.select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), *[v.cast("decimal(6,3)").alias(k) for k, v in signals.items()])


_SCORED = "SELECT p_partkey, split_part(p_type, ' ', 1) AS kind, p_size * 10 AS a, p_partkey % 997 AS b, (p_partkey * 7) % 500 AS c FROM part"


@query(f"""SELECT p_partkey, CAST(CAST(a * 0.40 + b * 0.35 + c * 0.25 AS DECIMAL(6,3)) AS DOUBLE) AS score, row_number() OVER (PARTITION BY kind ORDER BY a * 0.40 + b * 0.35 + c * 0.25 DESC, p_partkey) AS rank,
 array_to_string(list_filter([CASE WHEN a >= 300 THEN 'entrypoint_exposure' END, CASE WHEN b >= 300 THEN 'downstream_impact' END, CASE WHEN c >= 300 THEN 'structural_centrality' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ({_SCORED})""")
def rank_composite(t: Tables) -> DataFrame:
    scored = _scored(t).withColumns({"score": ranking.composite(WEIGHTS), "reasons": F.array_join(ranking.reasons(300, tuple(WEIGHTS)), ",")})
    return ranking.rank(scored, "score", "p_partkey", "kind").select("p_partkey", F.col("score").cast("double").alias("score"), "rank", "reasons")


_ROLE_ROWS = ", ".join(f"('{r}', '{k}', {w})" for r, k, w in ROLES)


@query(f"""SELECT role, p_partkey, row_number() OVER (PARTITION BY role ORDER BY a * w DESC, p_partkey) AS rank FROM ({_SCORED}) JOIN (VALUES {_ROLE_ROWS}) v(role, kind, w) USING (kind)""")
def rank_by_role(t: Tables) -> DataFrame:
    roles = t.spark.createDataFrame(ROLES, "role string, kind string, weight int")
    scored = _scored(t).withColumn("score", F.col("entrypoint_exposure"))
    return ranking.rank_by_role(scored, F.broadcast(roles), "p_partkey").select("role", "p_partkey", "rank")


@query(f"""SELECT role, p_partkey, row_number() OVER (PARTITION BY role ORDER BY c, p_partkey) AS step_order FROM ({_SCORED}) JOIN (VALUES {_ROLE_ROWS}) v(role, kind, w) USING (kind)""")
def role_path_order(t: Tables) -> DataFrame:
    roles = t.spark.createDataFrame(ROLES, "role string, kind string, weight int")
    joined = _scored(t).join(F.broadcast(roles), "kind")
    return numbered_by_range(joined, ["role"], F.col("structural_centrality"), F.col("p_partkey"), name="step_order").select("role", "p_partkey", "step_order")


@query("""SELECT a.o_orderkey, a.o_orderstatus AS was, b.o_orderstatus AS next, (a.o_orderstatus, b.o_orderstatus) IN (('O', 'P'), ('P', 'F'), ('F', 'F')) AS allowed
FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""")
def review_transitions(t: Tables) -> DataFrame:
    """Which changes of a package's status are allowed is ours."""
    following = t.orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderstatus").alias("next"))
    rules = t.spark.createDataFrame([("O", "P"), ("P", "F"), ("F", "F")], "was string, next string").withColumn("_ok", F.lit(True))
    joined = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("was")).join(following, "o_orderkey")
    return joined.join(F.broadcast(rules), ["was", "next"], "left").select("o_orderkey", "was", "next", F.col("_ok").isNotNull().alias("allowed"))
