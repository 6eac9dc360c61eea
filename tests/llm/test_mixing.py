"""Targets by repeated sharing, rates by a plain solver, whole results by their constraints and by a rerun."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomstead.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def shared(sizes, weights=(1, 2, 3), most=3):
    """Targets: share, stop at the cap, share what is above anew, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        free, left = free - over, left - sum(most * sizes[s] for s in over)
    return out


def tilt(sizes, target, most=3):
    low, high = -1e3, 1e3
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * math.exp(min(math.log(most), mid * n)) for n in sizes) < target else (low, mid)
    return low


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix(df, **how).collect()
    sizes, groups = {}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
        groups.setdefault(source, []).append(words(text))
    want = shared(sizes)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, words(t)) for i, t, _ in rows)
    for source, target in want.items():
        mine = [r for r in got if r["source"] == source]
        assert all(r["target"] == pytest.approx(target, abs=1e-6) and r["source_size"] == sizes[source] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 0.5 + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"] for r in mine)
        if target and target < 2.999 * sizes[source]:
            inked = [n for n in groups[source] if n]
            by = tilt(inked, target)
            expected = lambda n: math.exp(min(math.log(3), by * n))  # noqa: E731, B023
            # the solver stops within a word
            assert all(r["rate"] == pytest.approx(expected(r["size"]), abs=2e-2) for r in mine if r["size"])
            moved = [r for r in mine if r["size"] and not math.floor(r["rate"]) * r["size"] <= r["taken"] <= math.ceil(r["rate"]) * r["size"]]
            assert len(moved) <= 4
    return got, df


def test_random(spark, texts):
    rng = random.Random(4)
    rows = [(i, texts(int(rng.paretovariate(1.1) * 5) % 3000), f"src{int(rng.random() ** 2 * 7)}") for i in range(600)]
    got, df = check(spark, rows)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_hot_and_small_sources(spark, texts):
    """One source with most rows of one size, others of one document each, and caps that make others share anew."""
    rows = [(i, "a b c", "hot") for i in range(500)] + [(1000, texts(900), "é"), (1001, texts(40), "z"), (1002, "one", None), (1003, texts(300), "Z"), (1004, texts(7), "")]
    got, _ = check(spark, rows)
    assert {r["source"] for r in got if r["taken"] == 3 * r["size"]} >= {None, ""}


def test_edges(spark, edges):
    rows = [(r["doc_id"], r["text"], s) for r, s in zip(edges.collect(), ["a", None, "b", "b", "", "a"] * 9, strict=False)]
    check(spark, rows)
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("size", "rate", "target", "rows", "position", "_k")})
    assert mixing.mix(more).count() == len(rows)
    assert mixing.mix(more.limit(0)).count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, None, None), (None, "", "a")], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_native(spark, documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
