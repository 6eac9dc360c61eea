"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted on a bounded sample of labelled rows (`max_rows`, picked by hash of the id) and flattened into
complete binary arrays, which numpy descends for all rows of a batch at once. Statistics are taken of whole texts, over the
bytes of a batch at a time. Null texts count as empty; empty texts have all statistics 0 and a score like any other; very long texts
are read in slabs. Repeated rows of documents are scored each and, if labelled, count each in the sample; of several labels
of one doc_id the largest counts (ties). Rows of labels that are null or not 0 or 1 are left out; without labels of
both kinds every score is the share of ones (0.5 if there is none). An empty table of documents gives no rows. Other
columns, whatever their names, are not read, and `keep_good` gives them back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.neardup import raw_batches, word_hashes

#: Bytes whose share of a text is a statistic, besides the classes below.
MARKS = b"|!#$%&*.,:;?-_/<>{}@="
STATISTICS = 13 + len(MARKS)


def _byte_classes() -> np.ndarray:
    """256 x classes: lower case, upper case, digits, white space, line ends, beyond ASCII, then each mark."""
    b = np.arange(256)
    rows = [(97 <= b) & (b <= 122), (65 <= b) & (b <= 90), (48 <= b) & (b <= 57), (b == 32) | ((9 <= b) & (b <= 13)), b == 10, b > 127, *[b == m for m in MARKS]]
    return np.array(rows, np.float64).T


_CLASSES = _byte_classes()


_LINE_END = np.arange(256) == 10


def _repeats(owner: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each row has, and how often its most frequent one stands there."""
    distinct, most = np.zeros(rows), np.zeros(rows)
    if len(hashes):
        # rows in the upper bits, 44 bits of the hash below
        key = np.sort(owner.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        of = (key[first] >> np.uint64(44)).astype(np.int64)
        distinct = np.bincount(of, minlength=rows).astype(float)
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        most[of[begins]] = np.maximum.reduceat(np.diff(np.append(first, len(key))), begins)
    return distinct, most


def statistics(texts: pa.Array, batch_bytes: int = 1 << 19) -> np.ndarray:
    """Rows x STATISTICS over whole texts: shares of byte classes, then word and line figures.

    Words are what ASCII white space leaves, A-Z in lower case; lines end at line ends.
    """
    out = np.zeros((len(texts), STATISTICS))
    for a, b, raw, sizes in raw_batches(texts, batch_bytes):
        rows, bounds, size = b - a, np.concatenate([[0], np.cumsum(sizes)]), np.maximum(sizes, 1)
        if len(raw) > 4 * batch_bytes:
            counted = np.stack([np.bincount(raw[i:j], minlength=256) for i, j in zip(bounds, bounds[1:], strict=False)])
        else:
            counted = np.bincount(np.repeat(np.arange(rows) * 256, sizes) + raw, minlength=rows * 256).reshape(rows, 256)
        part = out[a:b]
        part[:, : _CLASSES.shape[1]] = counted @ _CLASSES / size[:, None]
        if not len(raw):
            continue
        begin, words = word_hashes(raw, bounds)
        owner = np.searchsorted(bounds, begin, "right") - 1
        n, (distinct, most) = np.bincount(owner, minlength=rows), _repeats(owner, words, rows)
        twice = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=rows)
        some = np.maximum(n, 1)
        part[:, -7:-2] = np.where(n > 0, [distinct / some, most / some, twice / some, sizes / some, np.log1p(n)], 0).T
        begin, lines = word_hashes(raw, bounds, _LINE_END)
        owner = np.searchsorted(bounds, begin, "right") - 1
        total, filled = counted[:, 10] + 1, np.bincount(owner, minlength=rows)
        different = _repeats(owner, lines, rows)[0] + (filled < total)
        part[:, -2:] = np.where(sizes > 0, [1 - different / total, np.log1p(sizes / total)], 0).T
    return out


@dataclass
class Forest:
    """Trees as arrays: node k of a tree has the children 2k+1 and 2k+2; leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, damping: float = 1.0) -> Forest:
    """Boost logistic loss; splits are sought in histograms of at most `bins` quantile bins."""
    inner = 2**depth - 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return Forest(forest.feature[:0], forest.threshold[:0], forest.leaf[:0], forest.base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width, columns = bins, x.shape[1]
    total = np.full(len(y), forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            here = node - first
            cell = ((here[:, None] * columns + np.arange(columns)) * width + binned).ravel()
            sums = [np.bincount(cell, np.repeat(v, columns), n * columns * width).reshape(n, columns, width).cumsum(2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + damping) + (gt - gl) ** 2 / (ht - hl + damping) - gt**2 / (ht + damping)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
            best = gain.reshape(n, -1).argmax(1)
            column, split = best // width, best % width
            for k in range(n):
                if gain[k, column[k], split[k]] > 1e-6:
                    forest.feature[t, first + k] = column[k]
                    forest.threshold[t, first + k] = edges[column[k]][split[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), forest.feature[t, node]] > forest.threshold[t, node])
        leaf = node - inner
        forest.leaf[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + damping)
        total += forest.leaf[t, leaf]
    return forest


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no model sees: crc32 of the id as text is divisible by folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 5) -> Forest:
    """Fit on at most max_rows labelled rows, of which the driver sees only the statistics."""
    spread = F.xxhash64("doc_id")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(spread, "doc_id").limit(max_rows)

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array(list(statistics(texts)), pa.list_(pa.float64()))

    # at most max_rows ids are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    got = rows.select("doc_id", "quality", stats("text").alias("x")).orderBy(spread, "doc_id", "x").limit(max_rows).collect()
    if not got:
        return fit(np.zeros((0, STATISTICS)), np.zeros(0))
    return fit(np.array([r["x"] for r in got]), np.array([r["quality"] for r in got], np.float64))


def scorer(forest: Forest):
    """An Arrow function from texts to scores."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(forest.score(statistics(texts)))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels has doc_id, quality."""
    score = scorer(train(docs, labels, max_rows))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """The rows of docs, with their columns, that the classifier doesn't reject."""
    return docs.where(scorer(train(docs, labels, max_rows))("text") >= threshold)
