"""Kept tables against recomputing everything, after random batches."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomstead.operators import kept

KINDS = {"nodes": "stable_key string, hash string, score long", "steps": "workflow_id string, step_order long, stable_key string", "sections": "section_id string, workflow_id string"}


def whole(nodes, steps, sections):
    """Steps with their nodes, section scores and ranks, by plain loops."""
    joined = Counter()
    for (w, o, k), n in steps.items():
        for (key, h, s), m in nodes.items():
            if k is not None and k == key:
                joined[w, o, k, h, s] += n * m
    totals = {}
    for (w, _, _, _, s), n in joined.items():
        count, score = totals.get(w, (0, 0))
        totals[w] = count + n, score + n * s
    scores = Counter()
    there = set()
    for (section, w), n in sections.items():
        if w is not None and w in totals:
            scores[section] += n * (1000 * totals[w][1] // totals[w][0])
            there.add(section)
    ranked = sorted(there, key=lambda s: (-scores[s], s))
    return joined, {s: (scores[s], i + 1) for i, s in enumerate(ranked)}


def stale(old, new):
    """Sections of before with a touched workflow, or a link more or less."""
    (joined, ranked, links), (joined_now, _, links_now) = old, new
    touched = {r[0] for r in set(joined) | set(joined_now) if joined[r] != joined_now[r]}
    relinked = {s for s, _ in set(links) | set(links_now) if Counter({k: v for k, v in links.items() if k[0] == s}) != Counter({k: v for k, v in links_now.items() if k[0] == s})}
    return {s for s, w in links if w in touched} | (relinked & set(ranked))


def frame(spark, kind, rows):
    return spark.createDataFrame([r for r, n in rows.items() for _ in range(n)], KINDS[kind])


def mutate(rng, tables, heavy):
    """The next snapshot: nodes change, steps and links come and go, some twice, some with null keys."""
    nodes, steps, sections = (Counter(t) for t in tables)
    for _ in range(heavy):
        key = f"n{rng.randrange(12)}"
        for r in [r for r in nodes if r[0] == key]:
            del nodes[r]
        if rng.random() < 0.8:
            nodes[key, f"h{rng.randrange(3)}", rng.randrange(50)] += 1
        steps[f"w{rng.randrange(6)}", rng.randrange(4), rng.choice([None, *[f"n{i}" for i in range(14)]])] += 1
        sections[f"s{rng.randrange(8)}", rng.choice([None, *[f"w{i}" for i in range(7)]])] += 1
        for t in (steps, sections):
            if len(t) > 4 and rng.random() < 0.7:
                del t[rng.choice(sorted(t, key=str))]
    return nodes, steps, sections


def test_random_batches(spark, tmp_path):
    rng = random.Random(1)
    analysis = kept.Analysis(spark, str(tmp_path / "kept"), parts=4, width=20_000)
    old, (joined, ranked) = (Counter(), Counter(), Counter()), (Counter(), {})
    for batch, heavy in enumerate([14, 2, 0, 3]):
        new = mutate(rng, old, heavy)
        joined_now, ranked_now = whole(*new)
        deltas = [kept.changes(frame(spark, k, a), frame(spark, k, b)) for k, a, b in zip(KINDS, old, new)]
        analysis.advance(batch, *deltas)
        if batch == 1:
            analysis.advance(batch, *deltas)  # a batch that runs again replaces itself
        got = {r["section_id"]: (r["score"], r["rank"]) for r in analysis.ranking(batch).collect()}
        assert got == ranked_now
        flags = [r["section_id"] for r in analysis.flagged(batch).collect()]
        assert sorted(flags) == sorted(stale((joined, ranked, old[2]), (joined_now, ranked_now, new[2])))
        old, joined, ranked = new, joined_now, ranked_now
    smaller = analysis.compacted(3, str(tmp_path / "smaller"))
    assert {r["section_id"]: (r["score"], r["rank"]) for r in smaller.ranking(3).collect()} == ranked
    new = mutate(rng, old, 2)
    smaller.advance(4, *[kept.changes(frame(spark, k, a), frame(spark, k, b)) for k, a, b in zip(KINDS, old, new)])
    assert {r["section_id"]: (r["score"], r["rank"]) for r in smaller.ranking(4).collect()} == whole(*new)[1]


def test_untouched_parts_are_not_read(spark, tmp_path):
    analysis = kept.Analysis(spark, str(tmp_path / "kept"), "long", parts=64)
    nodes = spark.range(1000).select(F.col("id").alias("stable_key"), F.lit("h").alias("hash"), F.col("id").alias("score"))
    steps = spark.range(1000).select((F.col("id") % 200).alias("workflow_id"), F.lit(1).cast("long").alias("step_order"), F.col("id").alias("stable_key"))
    sections = spark.range(200).select(F.col("id").alias("section_id"), F.col("id").alias("workflow_id"))
    analysis.advance(0, *[kept.signed(t) for t in (nodes, steps, sections)])
    changed = nodes.where("stable_key = 7").withColumn("score", F.lit(70).cast("long"))
    near = kept.changes(nodes.where("stable_key = 7"), changed)
    plan = analysis.state("steps", 0, near)
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = \d+", plan._jdf.queryExecution().executedPlan().toString())
    assert [r["workflow_id"] for r in plan.collect()] == [7]
    analysis.advance(1, near, kept.signed(steps).limit(0), kept.signed(sections).limit(0))
    assert [r["section_id"] for r in analysis.flagged(1).collect()] == [7]
    written = {n: analysis._rows(n).where("batch = 1").count() for n in kept.TABLES}
    assert written == {"nodes": 2, "steps": 0, "sections": 0, "totals": 1, "scores": 1, "ranks": 2, "bands": 2, "flags": 1}


def test_empty(spark, tmp_path):
    analysis = kept.Analysis(spark, str(tmp_path / "kept"), parts=4)
    analysis.advance(0, *[kept.signed(spark.createDataFrame([], KINDS[k])) for k in KINDS])
    assert analysis.ranking(0).count() == analysis.flagged(0).count() == 0


def test_nothing_before_and_parts_asked_once(spark, tmp_path, monkeypatch):
    """What is empty is dropped when a batch is planned, with the joins that it stands in; a table's parts are asked once."""
    analysis = kept.Analysis(spark, str(tmp_path / "kept"), "long", parts=4)
    rows = {
        "nodes": spark.range(9).select(F.col("id").alias("stable_key"), F.lit("h").alias("hash"), F.col("id").alias("score")),
        "steps": spark.range(9).select(F.col("id").alias("workflow_id"), F.col("id").alias("step_order"), F.col("id").alias("stable_key")),
        "sections": spark.range(9).select(F.col("id").alias("section_id"), F.col("id").alias("workflow_id")),
    }
    before = analysis.state("nodes", -1, rows["steps"])
    assert before.columns == ["stable_key", "hash", "score", "weight"] and before.count() == 0
    met = kept.times(kept.signed(rows["steps"]), before, "stable_key").unionByName(kept.times(kept.signed(rows["steps"]), kept.signed(rows["nodes"]), "stable_key"))
    assert met.count() == 9
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "RDD" not in plan
    analysis.advance(0, *[kept.signed(t) for t in rows.values()])
    collected, collect = [], type(before).collect
    monkeypatch.setattr(type(before), "collect", lambda self: collected.append(self) or collect(self))
    near = kept.signed(rows["steps"].where("stable_key < 3"))
    assert [analysis.state("nodes", 0, near).count() for _ in range(2)] == [3, 3] and len(collected) == 2
    analysis._touched = []  # as while a batch is carried through
    assert [analysis.state("nodes", 0, near).count() for _ in range(2)] == [3, 3] and len(collected) == 3
