"""Paths, workflows and computed signals against plain Python on small graphs."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from loomstead.operators import clusters, paths, ranking, signals, states


def graph(spark, edges):
    return spark.createDataFrame(edges, "source long, target long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def simple_paths(edges, starts, targets, depth):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out, front = set(), [(s,) for s in set(starts)]
    for _ in range(depth):
        front = [(*p, b) for p in front for b in after.get(p[-1], ()) if b not in p]
        out |= {p for p in front if p[-1] in targets}
    return out


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_paths_and_workflows(spark):
    edges = random_edges(30, 85, 3) + [(1, 1), (2, 3), (3, 2), (2, 3)]
    starts, targets = [0, 1, 2, 2, 99], [3, 7, 2, 11]
    found = paths.discover(graph(spark, edges), nodes(spark, starts), nodes(spark, targets), 5)
    want = simple_paths(edges, starts, targets, 5)
    assert sorted(tuple(r["path"]) for r in found.collect()) == sorted(want) and len(want) > 20
    assert all(r["start"] == r["path"][0] and r["target"] == r["path"][-1] for r in found.collect())
    text = lambda p: "," + ",".join(map(str, p)) + ","
    longest = {p for p in want if not any(len(q) > len(p) and text(p) in text(q) for q in want)}
    flows = paths.workflows(found)
    assert {tuple(r["path"]) for r in flows.collect()} == longest and len(longest) < len(want)
    steps = paths.workflow_steps(flows).collect()
    assert len({(r["workflow_id"], r["step_order"]) for r in steps}) == len(steps) == sum(map(len, longest))
    assert paths.discover(graph(spark, edges), nodes(spark, [99]), nodes(spark, targets), 5).count() == 0
    assert paths.discover(graph(spark, []), nodes(spark, [1]), nodes(spark, [2]), 5).count() == 0


def test_paths_through_a_hub(spark):
    """A hub with 10^5 edges out, of which one leads on, and as many in."""
    out = spark.range(100_000).selectExpr("0L as source", "id + 10 as target")
    into = spark.range(100_000).selectExpr("id + 200000 as source", "0L as target")
    edges = out.unionByName(into).unionByName(graph(spark, [(1, 0), (77, 5), (5, 6), (6, 0)]))
    got = paths.discover(edges, nodes(spark, [1, 200_003]), nodes(spark, [6]), 4)
    assert sorted(r["path"] for r in got.collect()) == [[1, 0, 77, 5, 6], [200_003, 0, 77, 5, 6]]


def reached(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, rest = set(), [n]
        while rest:
            for b in after.get(rest.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    rest.append(b)
        out[n] = len(seen)
    return out


def test_downstream(spark):
    edges = random_edges(60, 55, 1) + [(100, 101), (101, 102), (102, 100), (103, 103)]
    got = {r["node"]: (r["impact"], r["is_exact"]) for r in signals.downstream(graph(spark, edges)).collect()}
    assert got == {n: (k, True) for n, k in reached(edges).items()} and got[100] == (3, True) and got[103] == (1, True)
    assert signals.downstream(graph(spark, [])).count() == 0


def test_downstream_beyond_exact(spark):
    """Hubs, long reach and small sets side by side: estimates within five standard errors."""
    edges = [(0, i) for i in range(1, 4000)] + [(5000 + i, 5001 + i) for i in range(8)] + [(9000, 0), (9001, 5003)] + random_edges(40, 60, 9)
    want = reached(edges)
    got = {r["node"]: (r["impact"], r["is_exact"]) for r in signals.downstream(graph(spark, edges), exact=5).collect()}
    assert set(got) == set(want)
    for n, (impact, exact) in got.items():
        assert exact == (want[n] <= 5) and (impact == want[n] if exact else abs(impact - want[n]) <= max(1, 0.08 * want[n]))


def test_centrality(spark):
    edges = random_edges(40, 90, 2) + [(i, 3) for i in range(40)] + [(3, 3), (1, 2), (1, 2)]
    ids = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, t in set(edges):
        a[at[t], at[s]] = 1
    degree = a.sum(0)
    walk = np.where(degree > 0, a / np.maximum(degree, 1), 1 / len(ids))
    solved = np.linalg.solve(np.eye(len(ids)) - 0.6 * walk, np.full(len(ids), 0.4))
    got = {r["node"]: r["centrality"] for r in signals.centrality(graph(spark, edges), 0.6, 1e-12).collect()}
    assert np.abs(np.array([got[n] for n in ids]) - solved).max() < 1e-9
    assert signals.centrality(graph(spark, [])).count() == 0


def test_centrality_of_a_slow_part(spark):
    """A ring among very many nodes that come to rest at once is as exact as alone."""
    ring = [(i, (i + 1) % 20) for i in range(20)] + [(0, 10), (3, 15)]
    rest = spark.range(30_000).selectExpr("id + 1000 as source", "id + 100000 as target")
    walk = np.zeros((20, 20))
    for s, t in ring:
        walk[t, s] = 1 / sum(x == s for x, _ in ring)
    solved = np.linalg.solve(np.eye(20) - 0.5 * walk, np.ones(20))
    got = {r["node"]: r["centrality"] for r in signals.centrality(graph(spark, ring).unionByName(rest), 0.5).where("node < 20").collect()}
    assert max(abs(got[i] * solved.sum() / sum(got.values()) - solved[i]) for i in range(20)) < 1e-8


def broadcasts(spark, make):
    """The joins by broadcast in the plans that make() runs."""
    listed, plain = [], signals.materialize

    def noted(df, *args):
        listed.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *args)

    signals.materialize = noted
    try:
        listed.append(make()._jdf.queryExecution().executedPlan().toString())
    finally:
        signals.materialize = plain
    return sum(plan.count("BroadcastHashJoin") for plan in listed)


def test_signals_send_no_table_through_the_driver(spark):
    edges = graph(spark, random_edges(60, 80, 1) + [(0, i) for i in range(100, 200)])
    assert broadcasts(spark, lambda: signals.downstream(edges, exact=5)) == 0
    assert broadcasts(spark, lambda: signals.centrality(edges)) == 0


def test_downstream_of_a_long_chain(spark, monkeypatch):
    """Rounds grow with the logarithm of the way; ends of chains, cycles behind and forks that meet again."""
    edges = [(i, i + 1) for i in range(60)] + [(60, 61), (61, 62), (62, 60), (200, 201), (200, 202), (201, 203), (202, 203)]
    written, plain = [], signals.materialize
    monkeypatch.setattr(signals, "materialize", lambda df: (written.append(1), plain(df))[1])
    got = {r["node"]: (r["impact"], r["is_exact"]) for r in signals.downstream(graph(spark, edges)).collect()}
    assert got == {n: (k, True) for n, k in reached(edges).items()}
    assert len(written) <= 14


def test_churn_and_ranks(spark):
    """Weights halve; a busy node that nothing depends on doesn't lead."""
    day = lambda d: dt.datetime(2024, 1, d)
    log = spark.createDataFrame([(1, day(31)), (1, day(21)), (2, day(11)), (2, None), (None, day(1)), (3, dt.datetime(2024, 2, 9))], "node long, at timestamp")
    got = {r["node"]: r["churn"] for r in signals.churn(log, "node", "at", F.lit("2024-01-31"), 10).collect()}
    assert got == {1: 1.5, 2: 0.25, 3: 1.0}
    rows = [(i, float(i % 3), i * 1.0, 0.0) for i in range(20)] + [(99, 0.0, 0.0, 1e6)]
    df = spark.createDataFrame(rows, "node long, i double, c double, h double")
    names = {"i": "downstream_impact", "c": "structural_centrality", "h": "git_churn_recency"}
    for value, name in names.items():
        df = signals.by_rank(df, value, "node", name)
    weights = {"downstream_impact": 0.4, "structural_centrality": 0.35, "git_churn_recency": 0.25}
    ranked = ranking.rank(df.withColumn("score", ranking.composite(weights)), "score", "node").collect()
    assert next(r["rank"] for r in ranked if r["node"] == 99) > 5
    assert float(max(r["git_churn_recency"] for r in ranked)) == 999 == float(next(r["git_churn_recency"] for r in ranked if r["node"] == 99))


def test_package_states(spark):
    """A package with most changes over runs of runs, small ones, null ones and unknown changes, against a plain fold."""
    rules = {("draft", "submit"): "review", ("review", "approve"): "approved", ("review", "reject"): "draft", ("approved", "reopen"): "draft"}
    rng = random.Random(3)
    changes = ["submit", "approve", "reject", "reopen", "burn", None]
    log = [("hot", i, rng.choice(changes), "x") for i in range(700)] + [(k, i, rng.choice(changes), "y") for k in ("a", "b", None) for i in range(5)]
    df = spark.createDataFrame(log, "package string, seq long, asked string, state_note string").repartition(5)
    got = {(r["package"], r["seq"]): (r["position"], r["was"], r["state"], r["allowed"], r["state_note"]) for r in states.replayed(df, "package", "seq", "asked", ["draft", "review", "approved"], rules, "draft", run=8).collect()}
    want, now = {}, {}
    for package, seq, asked, note in log:
        was = now.get(package, "draft")
        now[package] = rules.get((was, asked), was)
        want[package, seq] = (seq + 1, was, now[package], (was, asked) in rules, note)
    assert got == want
    assert states.replayed(df.limit(0), "package", "seq", "asked", ["draft", "review", "approved"], rules, "draft").count() == 0


def test_communities(spark):
    """Planted clusters come back, and modularity is that of plain Python's sums and above that of nodes alone."""
    rng = random.Random(1)
    edges = [(9 * c + i, 9 * c + j, 1.0) for c in range(5) for i in range(9) for j in range(i) if rng.random() < 0.9] + [(9 * c, (9 * c + 10) % 45, 1.0) for c in range(5)] + [(100, 100, 2.0)]
    labels, quality = clusters.communities(spark.createDataFrame([*edges, (None, 3, 1.0), (1, 2, 0.0)], "a long, b long, weight double"))
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert got == {n: 9 * (n // 9) for n in range(45)} | {100: 100}
    total, inside, k = 0.0, 0.0, {}
    for a, b, w in edges:
        total, inside = total + 2 * w, inside + 2 * w * (got[a] == got[b])
        for n in (a, b):
            k[got[n]] = k.get(got[n], 0.0) + w
    assert abs(quality - (inside / total - sum((v / total) ** 2 for v in k.values()))) < 1e-9 and quality > 0.5
    assert clusters.communities(spark.createDataFrame([], "a long, b long, weight double"))[0].count() == 0


def test_module_edges(spark):
    modules = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "node long, module string")
    got = {(r["a"], r["b"]): r["weight"] for r in clusters.module_edges(graph(spark, [(1, 3), (3, 2), (1, 2), (1, 9)]), modules).collect()}
    assert got == {("x", "y"): 2.0, ("x", "x"): 1.0}


def test_module_communities(spark, sf_dir):
    """The query without SQL: each module once, and clusters above what modules alone or all together give."""
    from loomstead.plans import registry

    assert set(registry.queries()) - set(registry.oracle_sql()) == {"module_communities"}
    cluster = {r["module"]: r["cluster"] for r in registry.queries()["module_communities"](spark, sf_dir).collect()}
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size").collect()
    module, n = {p["p_partkey"]: f"{p['p_brand']} {p['p_type']}" for p in parts}, len(parts)
    calls = [(p["p_partkey"], (p["p_partkey"] * f + s) % n) for p in parts for rule, f, s in ((p["p_size"] % 2 == 1, 7, 3), (p["p_size"] % 3 == 0, 11, 5), (p["p_size"] > 25, 3, 1)) if rule]
    assert set(cluster) == {module[x] for call in calls for x in call}

    def quality(label):
        inside, k = sum(label[module[a]] == label[module[b]] for a, b in calls) / len(calls), {}
        for call in calls:
            for x in call:
                k[label[module[x]]] = k.get(label[module[x]], 0) + 1
        return inside - sum((v / 2 / len(calls)) ** 2 for v in k.values())

    assert quality(cluster) > max(quality({m: m for m in cluster}), 0) and all(min(m for m in cluster if cluster[m] == c) == c for c in set(cluster.values()))
