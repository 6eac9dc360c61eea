"""The scatter against whole numbers in Python, whitened vectors against a plain decomposition."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from loomstead.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def integers(vectors):
    return [[floor(Fraction(float(np.float32(c))) * 1024) + 100_000 for c in v] for v in vectors]


def exact(x):
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    return n, s, [[n * sum(v[i] * v[j] for v in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def check(spark, vectors, **how):
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    x = integers(vectors)
    n, s, scattered = exact(x)
    got_n, got_s, got_scatter = whitening.scatter(df)
    assert got_n == n and got_scatter == scattered and [a + n * 100_000 for a in got_s] == s
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in scattered])
    values, axes = np.linalg.eigh(covariance)
    rows = whitening.whiten(df, **how).collect()
    deviations = [sum((n * v - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    for r in rows:
        k = r["component"]
        centred = np.array([float(Fraction(n * v - t, n)) for v, t in zip(x[r["vec_id"]], s, strict=True)])
        want = centred @ axes[:, -k] / np.sqrt(values[-k])
        assert abs(abs(want) - abs(r["whitened"])) < 1e-6 and r["n"] == n
        assert r["explained"] == pytest.approx(values[-k] / covariance.trace(), rel=1e-6) and r["identity_error"] < 1e-4
        assert r["deviation_exact"] == (deviations[r["vec_id"]] if deviations[r["vec_id"]] < 10**38 else None)
        assert r["deviation"] == (deviations[r["vec_id"]] if deviations[r["vec_id"]] < 1 << 63 else None)
    return rows


def test_random(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    assert len(check(spark, vectors)) == 300 * 8 and len(check(spark, vectors[:, :3])) == 300 * 3
    assert len(check(spark, vectors, most=2)) == 600


def test_large_entries(spark):
    """Entries of several digits, and deviations that are no long."""
    rng = np.random.default_rng(2)
    rows = check(spark, (rng.normal(size=(60, 4)) * 1e12).astype(np.float32))
    assert len(rows) == 240 and all(r["deviation"] is None for r in rows)


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [r["embedding"] for r in df.orderBy("vec_id").collect()]
    rows = whitening.whiten(df).collect()
    x = np.floor(np.array(vectors, np.float64) * 1024) + 100_000
    w = np.zeros((len(x), 8))
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:8]
    assert {r["component"]: r["explained"] for r in rows} == pytest.approx({k + 1: v / np.cov(x.T, bias=True).trace() for k, v in enumerate(values)})


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, 7.25]), (2, [-3.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, [1.0, 2.0, 3.0]), (9, [3e38, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", whitened string, n double")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert all(r["n"] == 4 for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).columns == whitening.whiten(df).columns
