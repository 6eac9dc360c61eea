"""The classifier: held-out accuracy, flattened trees against plain descent, edges."""

import re
import zlib

import numpy as np
import pyarrow as pa

from loomstead.llm import quality


def test_held_out(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.classify(documents, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    out = [r["predicted"] == r["quality"] for r in got if r["held_out"]]
    assert len(out) > 50 and sum(out) / len(out) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = (quality.train(documents, x) for x in (labels, flipped))
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_forest_descends_like_a_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > -0.1)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:50]:
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert abs(forest.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_edges(spark, edges, nothing, documents):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (3, None, "x"), (4, 7, "x"), (5, 1, "x"), (5, 0, "x"), (None, 1, "x"), (6, 1, "x"), (7, 0, "x")], "doc_id long, quality int, text string")
    got = quality.classify(edges, labels).collect()
    assert len(got) == edges.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(edges, labels, threshold=0.0).columns == edges.columns
    assert quality.classify(nothing, labels).count() == 0
    none = quality.classify(edges, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    ones = quality.classify(edges, labels.where("quality = 1")).collect()
    assert len({r["score"] for r in ones}) == 1 and ones[0]["score"] > 0.9


def test_statistics():
    got = quality.statistics(pa.array([None, "", "a a b\na a b", "\n"]))
    assert not got[:2].any() and got.shape == (4, quality.STATISTICS)
    assert got[2, -7] == 2 / 6 and got[2, -2] == 0.5


def plain_statistics(text):
    raw = (text or "").encode()
    out = np.zeros(quality.STATISTICS)
    if raw:
        out[: quality._CLASSES.shape[1]] = sum(quality._CLASSES[b] for b in raw) / len(raw)
        words, lines = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw.lower()) if w], raw.lower().split(b"\n")
        if words:
            n, most = len(words), max(words.count(w) for w in set(words))
            out[-7:-2] = len(set(words)) / n, most / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(raw) / n, np.log1p(n)
        out[-2:] = 1 - len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines))
    return out


def test_statistics_against_plain_ones(documents, monkeypatch):
    texts = [r["text"] for r in documents.select("text").limit(150).collect()] + [None, "", " ", "\n\n", "a\na\n", "A a a b", "x" * 5000, "é É\n"]
    want = np.array([plain_statistics(t) for t in texts])
    for size in (1 << 19, 1000):
        assert np.allclose(quality.statistics(pa.array(texts), size), want)


def test_splits_against_plain_search():
    """Each split of the first tree is the best of all splits at the bins' edges, sought without histograms."""
    rng = np.random.default_rng(2)
    x, bins, depth = np.round(rng.normal(size=(400, 4)), 1), 16, 3
    y = ((x[:, 1] > 0.3) | (x[:, 2] > 1)).astype(float)
    forest = quality.fit(x, y, trees=1, depth=depth, bins=bins)
    p = np.full(len(y), y.mean())
    g, h, nodes = y - p, p * (1 - p), {0: np.ones(len(y), bool)}
    for node in range(2**depth - 1):
        here, best = nodes[node], (1e-6, None)
        for c in range(4):
            for edge in np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])):
                left, right = here & (x[:, c] <= edge), here & (x[:, c] > edge)
                if left.any() and right.any():
                    gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, right)) - g[here].sum() ** 2 / (h[here].sum() + 1)
                    best = max(best, (gain, (c, edge)), key=lambda t: t[0] + (1e-9 if best[1] is None else 0))
        feature, threshold = forest.feature[0, node], forest.threshold[0, node]
        left = here & (x[:, feature] <= threshold)
        if best[1] is None:
            assert not np.isfinite(threshold)
        else:
            own = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, here & ~left)) - g[here].sum() ** 2 / (h[here].sum() + 1)
            assert abs(own - best[0]) < 1e-9
        nodes[2 * node + 1], nodes[2 * node + 2] = left, here & ~left
