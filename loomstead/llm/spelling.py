"""Spelling variants by full neighbourhoods: every distinct deletion, replacement and insertion of a word, looked up.

1. Runs of letters of whole texts are counted; the vocabulary has the distinct words of LEAST_LENGTH code points and
   LEAST occurrences. The alphabet is what the vocabulary is written with, at most the letters of the pattern.
2. An edit leaves the first half of a word as it is, or the last: the candidates of the edits behind the half are
   looked up among the words with the same first half, the others among those with the same last half. So a word is
   sent to a few tasks, and no candidate is. There each candidate's hash, which follows from the word's sums without
   spelling it out, is looked up in a table of the task's words; a hit is spelled and is the word that it met. The
   same string is made by one edit only (of equal neighbours the last goes, a letter is put behind its equals), so
   neither distances nor duplicates need a look.
3. A half that more than HOT words share is too much for one task: candidates of its words are spelled out and joined
   with the vocabulary instead.
4. Near words are counted, the most frequent gives the form, and forms are followed to their ends by doubling.

Null and empty texts have no words. Rows without doc_id have words, from which nothing is deleted, as there is nothing
to hash. Repeated rows count each time. Words of any length are taken (candidates of a long word are made a block at a
time). Of near words with equal n (ties) the smallest in code-point order is the form. Other columns of docs, whatever
their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import lower_ascii, materialize

LEAST_LENGTH, LEAST, RATIO, ONE_IN = 7, 2, 10, 31
#: Words of a task, and those with one half from which on they are joined by Spark.
PART, HOT = 1 << 16, 1 << 20
#: Candidates that are hashed at a time.
BLOCK = 1 << 20
NEAR = "word string, near string, n long"
_M = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _codes() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _M
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: A number for each letter; all of them are below 256.
_CODES = _codes()


def vocabulary(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """word, n of the words of docs (doc_id, text); of one run in `one_in`, by hash of it and doc_id, a letter is deleted."""
    # shorter runs give no word
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{length},}}+"), F.lit(0)))
    runs = docs.select("doc_id", run.alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def halves(words: DataFrame) -> DataFrame:
    """side (0: first half, 1: last), cut (its length), key of what each word shares with words near it.

    Of two near words the shorter (or either) is cut in the middle; a word may be the shorter or the longer one.
    """
    size = F.length("word")
    half, ceiling, lower = F.floor(size / 2), F.ceil(size / 2), F.floor((size - 1) / 2)
    sides = lambda side, *cuts: F.transform(F.array_distinct(F.array(*cuts)), lambda c: F.struct(F.lit(side).alias("side"), c.cast("int").alias("cut")))
    dealt = words.select("word", "n", F.explode(F.concat(sides(0, half, lower), sides(1, ceiling, half))).alias("_h")).select("word", "n", "_h.side", "_h.cut")
    shared = F.when(F.col("side") == 0, F.left("word", F.col("cut"))).otherwise(F.right("word", F.col("cut")))
    return dealt.withColumn("key", F.xxhash64("side", "cut", shared))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INVERSE):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        out.append(np.cumprod(table))
    return out[0], out[1]


class _Words:
    """Words as letters and sums: sums[first[i] + i + p] is the hash of the first p letters of word i."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.power, _ = _powers(int(self.sizes.max(initial=0)) + 2)
        place = np.arange(len(self.letters)) - np.repeat(self.first, self.sizes)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[self.letters] * self.power[place])])
        self.hashes = self.total[self.first + self.sizes] - self.total[self.first]

    def edits(self, rows: np.ndarray, side: int, cut: int, alphabet: np.ndarray, keep: Callable) -> Iterator[tuple[int, str]]:
        """(row, candidate) of rows, all of one length, for the edits that leave this half; keep(hashes) tells which are spelled."""
        size = int(self.sizes[rows[0]])
        if cut == (size // 2 if side == 0 else -(-size // 2)):
            half = size // 2
            yield from self._lettered(rows, size, range(half, size) if side == 0 else range(half), alphabet, keep, False)
            yield from self._lettered(rows, size, range(half, size + 1) if side == 0 else range(half), alphabet, keep, True)
        if cut == ((size - 1) // 2 if side == 0 else size // 2):
            half = (size - 1) // 2
            yield from self._deleted(rows, size, range(half, size) if side == 0 else range(half), keep)

    def _blocks(self, rows: np.ndarray, places: range, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at_once = max(1, BLOCK // width)
        deep = min(len(places), at_once)
        for p in range(0, len(places), max(1, deep)):
            span = np.arange(places.start + p, min(places.start + p + deep, places.stop))
            for r in range(0, len(rows), max(1, at_once // deep)):
                yield rows[r : r + max(1, at_once // deep)], span

    def _lettered(self, rows: np.ndarray, size: int, places: range, alphabet: np.ndarray, keep: Callable, insert: bool) -> Iterator[tuple[int, str]]:
        codes = _CODES[alphabet]
        for part, span in self._blocks(rows, places, len(alphabet)):
            start = self.first[part][:, None]
            here = np.where(span < size, self.letters[np.minimum(start + span, len(self.letters) - 1)], 0)
            before = self.total[start + span] - self.total[start]
            if insert:
                base = before + (self.hashes[part][:, None] - before) * _P
            else:
                base = self.hashes[part][:, None] - _CODES[here] * self.power[span]
            hashes = base[:, :, None] + codes * self.power[span][:, None]
            i, j, k = np.nonzero(keep(hashes) & (here[:, :, None] != alphabet))
            for row, p, c in zip(part[i].tolist(), span[j].tolist(), alphabet[k].tolist(), strict=True):
                word = self.words[row]
                yield row, word[:p] + chr(c) + word[p + (not insert) :]

    def _deleted(self, rows: np.ndarray, size: int, places: range, keep: Callable) -> Iterator[tuple[int, str]]:
        for part, span in self._blocks(rows, places, 1):
            start = self.first[part][:, None]
            behind = self.letters[np.minimum(start + span + 1, len(self.letters) - 1)]
            last = (span == size - 1) | (self.letters[start + span] != behind)
            hashes = self.total[start + span] - self.total[start] + (self.total[start + size] - self.total[start + span + 1]) * _P_INVERSE
            i, j = np.nonzero(keep(hashes) & last)
            for row, p in zip(part[i].tolist(), span[j].tolist(), strict=True):
                yield row, self.words[row][:p] + self.words[row][p + 1 :]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> tuple[_Words, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Words, their n, and (side, cut, rows of one length)."""
    table = pa.Table.from_batches(list(batches))
    words = _Words(table["word"].to_pylist())
    side, cut = table["side"].to_numpy(), table["cut"].to_numpy()
    order = np.lexsort((cut, side, words.sizes))
    keys = np.stack([words.sizes[order], side[order], cut[order]])
    edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
    return words, table["n"].to_numpy(), [(int(keys[1, a]), int(keys[2, a]), order[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _batches_of(found: Iterator[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, str, int]] = []
    for row in found:
        out.append(row)
        if len(out) >= 1 << 14:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["word", "near", "n"])


def looked_up(alphabet: np.ndarray) -> Callable:
    """NEAR of the words of a partition of halves: candidates looked up in a table of its own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        words, n, groups = _rows_of(iter(given))
        known = np.unique(words.hashes)
        here = set(words.words)
        shift = np.uint64(64 - max(16, (16 * len(known)).bit_length()))
        marks = np.zeros(1 << (64 - int(shift)), bool)
        marks[(known * _M) >> shift] = True

        def keep(hashes: np.ndarray) -> np.ndarray:
            likely = marks[(hashes * _M) >> shift]
            some = np.nonzero(likely)
            asked = hashes[some]
            likely[some] = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
            return likely

        def found() -> Iterator[tuple[str, str, int]]:
            for side, cut, rows in groups:
                for row, candidate in words.edits(rows, side, cut, alphabet, keep):
                    # two words of one hash are told apart by their letters
                    if candidate in here:
                        yield candidate, words.words[row], int(n[row])

        yield from _batches_of(found())

    return run


def spelled(alphabet: np.ndarray) -> Callable:
    """NEAR of all candidates of the words of a batch of halves, which may be words or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words, n, groups = _rows_of(iter([batch]))
                everything = lambda hashes: np.ones(hashes.shape, bool)
                yield from _batches_of((candidate, words.words[row], int(n[row])) for side, cut, rows in groups for row, candidate in words.edits(rows, side, cut, alphabet, everything))  # noqa: B023

    return run


def near_words(words: DataFrame, part: int = PART, hot: int = HOT) -> DataFrame:
    """NEAR: each pair of near words of words (word, n) in both directions; n is that of near."""
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint8)
    dealt = halves(words)
    crowded = materialize(dealt.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("key"))
    plain = dealt.select("word", "n", "side", "cut", "key")
    parts = max(1, -(-3 * words.count() // part))
    some_crowded = not crowded.isEmpty()
    few = plain.join(crowded, "key", "left_anti") if some_crowded else plain
    near = few.repartition(parts, "key").select("word", "n", "side", "cut").mapInArrow(looked_up(alphabet), NEAR)
    if not some_crowded:
        return near
    many = plain.join(crowded, "key", "left_semi").select("word", "n", "side", "cut").repartition(parts)
    return near.unionByName(many.mapInArrow(spelled(alphabet), NEAR).join(words.select("word"), "word", "left_semi"))


def followed(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form) from each word that has one.

    A form is `ratio` times as frequent as its word, so chains are as long as n has digits, and doubling ends soon.
    """
    ahead = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = materialize(ahead.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        ahead = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return ahead


def group(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST, ratio: int = RATIO, one_in: int = ONE_IN, part: int = PART, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of docs (doc_id, text)."""
    words = materialize(vocabulary(docs, length, least, one_in))
    best = F.min(F.struct((-F.col("n")).alias("m"), "near"))
    counted = near_words(words, part, hot).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_b"))
    joined = words.join(counted, "word", "left")
    formed = F.coalesce(-F.col("_b.m") >= F.col("n") * ratio, F.lit(False))
    known = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("_b.near")).alias("form"), F.when(formed, -F.col("_b.m")).alias("form_n")))
    roots = followed(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB: crc32 byte by byte from its rule; near words by what is left when a letter is deleted from each.
GROUP_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))
), u AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), r AS (SELECT doc_id, run, count(*) AS k FROM u GROUP BY 1, 2),
b AS (SELECT *, flatten(list_transform(range(1, length(doc_id || ':' || run) + 1), lambda i: CASE WHEN unicode((doc_id || ':' || run)[i]) < 128 THEN [unicode((doc_id || ':' || run)[i])::BIGINT] ELSE [195::BIGINT, unicode((doc_id || ':' || run)[i]) - 64] END)) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, c: xor(a >> 8, crc[(xor(a & 255, c) + 1)::INT])), 4294967295) AS h FROM b, t),
d AS (SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
x AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word
),
best AS (SELECT word, count(*) AS n_near, (min({'m': -n, 'near': encode(near)})).m AS m, decode((min({'m': -n, 'near': encode(near)})).near) AS near FROM near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m >= 10 * w.n THEN near END AS form, CASE WHEN -m >= 10 * w.n THEN -m END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS following FROM f UNION ALL SELECT c.word, c.following, f.form FROM chain c JOIN f ON f.word = c.following)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.following IS NULL
"""
