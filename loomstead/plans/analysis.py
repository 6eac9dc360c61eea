"""Paths, workflows and computed signals over the benchmark tables: parts stand in for code, their shipments for changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators import clusters, paths, ranking, signals, states
from loomstead.plans.base import Registry, Tables

query = Registry()
DEPTH, DAMPING, HALF_LIFE = 7, 0.5, 90
#: Which parts call which: (those for which it holds, factor, step); the graph has cycles and grows with the table.
CALLS = [("p_size % 2 = 1", 7, 3), ("p_size % 3 = 0", 11, 5), ("p_size > 25", 3, 1)]
STARTS, TARGETS = "p_type = 'PROMO' AND p_size <= 10", "p_brand = 'Brand#11'"
WEIGHTS = {"downstream_impact": 0.4, "structural_centrality": 0.35, "git_churn_recency": 0.25}


def _calls(t: Tables, kinds: int = len(CALLS)) -> DataFrame:
    n = t.part.count()
    calls = [F.when(F.expr(rule), (F.col("p_partkey") * factor + step) % n) for rule, factor, step in CALLS[:kinds]]
    return t.part.select(F.col("p_partkey").alias("source"), F.explode(F.array_compact(F.array(*calls))).alias("target"))


def _calls_sql(kinds: int = len(CALLS)) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey AS source, (p_partkey * {factor} + {step}) % (SELECT count(*) FROM part) AS target FROM part WHERE {rule}" for rule, factor, step in CALLS[:kinds])


def _paths(t: Tables) -> DataFrame:
    node = F.col("p_partkey").alias("node")
    return paths.discover(_calls(t), t.part.where(STARTS).select(node), t.part.where(TARGETS).select(node), DEPTH)


_PATHS = f"""e AS (SELECT DISTINCT * FROM ({_calls_sql()})),
w AS (SELECT p_partkey AS node, [p_partkey] AS path FROM part WHERE {STARTS}
 UNION ALL SELECT e.target, list_append(w.path, e.target) FROM w JOIN e ON e.source = w.node WHERE NOT list_contains(w.path, e.target) AND len(w.path) <= {DEPTH}),
p AS (SELECT path[1] AS start, node AS target, array_to_string(path, '>') AS path FROM w JOIN part ON p_partkey = node WHERE {TARGETS} AND len(path) > 1)"""


@query(f"WITH RECURSIVE {_PATHS} SELECT * FROM p")
def entrypoint_paths(t: Tables) -> DataFrame:
    return _paths(t).select("start", "target", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


@query(f"""WITH RECURSIVE {_PATHS}, m AS (SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE length(q.path) > length(p.path) AND contains('>' || q.path || '>', '>' || p.path || '>')))
SELECT sha256(replace(path, '>', chr(10))) AS workflow_id, CAST(unnest(range(1, len(string_split(path, '>')) + 1)) AS INTEGER) AS step_order, CAST(unnest(string_split(path, '>')) AS BIGINT) AS node FROM m""")
def workflow_steps(t: Tables) -> DataFrame:
    return paths.workflow_steps(paths.workflows(_paths(t)))


_REACHED = f"""e AS (SELECT DISTINCT * FROM ({_calls_sql(2)})), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON e.source = r.target),
nodes AS (SELECT source AS node FROM e UNION SELECT target FROM e), i AS (SELECT node, count(target) AS impact FROM nodes LEFT JOIN r ON source = node GROUP BY 1)"""


@query(f"WITH RECURSIVE {_REACHED} SELECT node, CASE WHEN impact <= {signals.EXACT} THEN impact END AS impact, impact <= {signals.EXACT} AS is_exact FROM i")
def downstream_impact(t: Tables) -> DataFrame:
    """Sets beyond signals.EXACT are estimated; SQL can't give the same estimate, so it is left out here."""
    counted = signals.downstream(_calls(t, 2))
    return counted.select("node", F.when(F.col("is_exact"), F.col("impact")).alias("impact"), "is_exact")


_WALK = f"""e3 AS (SELECT DISTINCT * FROM ({_calls_sql()})), d AS (SELECT source, count(*) AS d FROM e3 GROUP BY 1), n3 AS (SELECT source AS node FROM e3 UNION SELECT target FROM e3),
y AS (SELECT node, CAST(1 AS DOUBLE) AS held, 0 AS i FROM n3 UNION ALL SELECT node, 1 + {DAMPING} * sum(s), i + 1 FROM (
 SELECT e3.target AS node, y.held / d.d AS s, y.i FROM y JOIN e3 ON e3.source = y.node JOIN d ON d.source = y.node UNION ALL SELECT node, 0, i FROM y) GROUP BY node, i HAVING i < 60),
c AS (SELECT node, round(held * count(*) OVER () / sum(held) OVER (), 6) AS centrality FROM y WHERE i = 60)"""


def _central(t: Tables) -> DataFrame:
    return signals.centrality(_calls(t), DAMPING).select("node", F.round("centrality", 6).alias("centrality"))


@query(f"WITH RECURSIVE {_WALK} SELECT * FROM c")
def structural_centrality(t: Tables) -> DataFrame:
    return _central(t)


_CHURN = f"SELECT l_partkey AS node, round(sum(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-01-01') - epoch_us(l_shipdate)) / 86400e6) / {HALF_LIFE})), 6) AS churn FROM lineitem WHERE l_partkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1"


def _churn(t: Tables) -> DataFrame:
    return signals.churn(t.lineitem, "l_partkey", "l_shipdate", F.lit("2024-01-01"), HALF_LIFE).select(F.col("l_partkey").alias("node"), F.round("churn", 6).alias("churn"))


@query(_CHURN)
def churn_recency(t: Tables) -> DataFrame:
    return _churn(t)


_SHARE = "CAST((row_number() OVER (ORDER BY {0}, node) - 1) * 999 / CAST(greatest(count(*) OVER () - 1, 1) AS DOUBLE) AS DECIMAL(6,3))"


@query(f"""WITH RECURSIVE {_REACHED}, {_WALK}, h AS ({_CHURN}),
s AS (SELECT p_partkey AS node, least(coalesce(impact, 0), {signals.EXACT + 1}) AS impact, coalesce(centrality, 0) AS centrality, coalesce(churn, 0) AS churn
 FROM part LEFT JOIN i ON i.node = p_partkey LEFT JOIN c ON c.node = p_partkey LEFT JOIN h ON h.node = p_partkey),
g AS (SELECT node, {_SHARE.format("impact")} AS a, {_SHARE.format("centrality")} AS b, {_SHARE.format("churn")} AS c FROM s)
SELECT node, CAST(CAST(a * 0.40 + b * 0.35 + c * 0.25 AS DECIMAL(6,3)) AS DOUBLE) AS score, row_number() OVER (ORDER BY CAST(a * 0.40 + b * 0.35 + c * 0.25 AS DECIMAL(6,3)) DESC, node) AS rank FROM g""")
def rank_computed(t: Tables) -> DataFrame:
    """Parts ranked by computed signals, each by its rank among all parts; impact is no finer beyond what is exact."""
    impact = signals.downstream(_calls(t, 2)).select("node", F.when(F.col("is_exact"), F.col("impact")).otherwise(signals.EXACT + 1).alias("_impact"))
    joined = t.part.select(F.col("p_partkey").alias("node")).join(impact, "node", "left").join(_central(t), "node", "left").join(_churn(t), "node", "left").fillna(0)
    for value, name in (("_impact", "downstream_impact"), ("centrality", "structural_centrality"), ("churn", "git_churn_recency")):
        joined = signals.by_rank(joined, value, "node", name)
    scored = joined.withColumn("score", ranking.composite(WEIGHTS))
    return ranking.rank(scored, "score", "node").select("node", F.col("score").cast("double").alias("score"), "rank")


#: States of a package, and which change leads where; which changes are allowed is ours.
STATES, RULES = ["O", "P", "F"], {("O", "P"): "P", ("P", "F"): "F", ("P", "O"): "O", ("F", "O"): "O"}


@query(f"""WITH RECURSIVE l AS (SELECT o_custkey, o_orderkey, o_orderstatus AS asked, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders),
rules(was, asked, state) AS (VALUES {", ".join(f"('{s}', '{a}', '{n}')" for (s, a), n in RULES.items())}),
f AS (SELECT l.*, 'O' AS was, coalesce(state, 'O') AS state, state IS NOT NULL AS allowed FROM l LEFT JOIN rules ON was = 'O' AND rules.asked = l.asked WHERE position = 1
 UNION ALL SELECT l.*, f.state, coalesce(r.state, f.state), r.state IS NOT NULL FROM f JOIN l ON l.o_custkey = f.o_custkey AND l.position = f.position + 1 LEFT JOIN rules r ON r.was = f.state AND r.asked = l.asked)
SELECT * FROM f""")
def package_states(t: Tables) -> DataFrame:
    """Customers stand in for packages, their orders' statuses for asked changes."""
    log = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("asked"))
    return states.replayed(log, "o_custkey", "o_orderkey", "asked", STATES, RULES, "O")


@query()
def module_communities(t: Tables) -> DataFrame:
    """Brands stand in for modules; those that call one another more than chance would are a cluster."""
    modules = t.part.select(F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_brand", "p_type").alias("module"))
    labels, _ = clusters.communities(clusters.module_edges(_calls(t), modules))
    return labels.select(F.col("node").alias("module"), F.col("label").alias("cluster"))
