"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may be off by k = floor(error_rate * n) words inserted, dropped or replaced. Of k + 1 pieces
that it is split into, one at least then stands in the document unchanged: exact hits of pieces are looked up, and
Myers' bit-parallel distance confirms the words around them. A piece that many items have, such as the words with which
questions begin, is looked up together with a second word: of any k + 1 words of the item outside the piece one at
least stands near, so that the rarest tell which of the items can be meant. Hits of one item on one diagonal, and places
with the same words as far as the benchmark knows them, are confirmed once; so are only those that hold n - k
of the item's words.

Words are runs of letters and digits, compared in lower case; scripts that are written without spaces (Chinese, Japanese,
Thai, ...) have no such runs, so each of their letters, digits and vowel or tone signs is a word of its own. Items without words
match nothing; short items (k = 0) match only whole. Null and empty texts hold no item. Repeated rows give repeated
results, ties between places the first; very long texts are searched whole. An empty benchmark or empty documents
give none. Other columns of docs and benchmark, whatever their names, are not read.

The benchmark is a query set against all rows: it is taken in rounds of at most `round_bytes` of text, each of which is
broadcast and reads the documents once. Workers index a round in blocks of `block_bytes`, one at a time.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import materialize

FOUND = "array<struct<item_id:bigint,item_words:int,distance:int,first_word:bigint,last_word:bigint>>"
_WORD = re.compile(r"[^\W_]+")
#: Blocks of scripts without spaces: Thai, Lao, Myanmar, Khmer, Tai Le, New Tai Lue, Tai Tham, Balinese, Javanese, Tai Viet, kana, Bopomofo, Ahom.
_MIXED_BLOCKS = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303C),
    (0x3041, 0x30FF), (0x3105, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xFF66, 0xFF9F), (0x116D0, 0x1174F), (0x1AFF0, 0x1B16F),
)
#: Ideographs and syllables throughout: Han, Yi, Tangut, Khitan, Nushu.
_WHOLE_BLOCKS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48C), (0xF900, 0xFAFF), (0x17000, 0x18D8F), (0x1B170, 0x1B2FF), (0x20000, 0x3FFFD))
_SIGNS, _LETTERS = ("".join(chr(c) for a, b in _MIXED_BLOCKS for c in range(a, b + 1) if unicodedata.category(chr(c))[0] in kinds) for kinds in ("M", "LN"))
_UNSPACED = re.compile(f"[{_SIGNS}{_LETTERS}{''.join(f'{chr(a)}-{chr(b)}' for a, b in _WHOLE_BLOCKS)}]")
_WORD_OR_SIGN = re.compile(rf"[^\W_]+|[{_SIGNS}]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Pieces of more items than this are looked up with a second word.
COMMON = 8


def words(text: str) -> list[str]:
    text = text.lower()
    alone = None if text.isascii() else _UNSPACED.findall("".join(set(text)))
    if not alone:
        return _WORD.findall(text)
    return _WORD_OR_SIGN.findall(text.translate({ord(c): f" {c} " for c in alone}))


def myers(codes: list[int], masks: dict[int, int], m: int) -> tuple[int, int]:
    """Least distance of a pattern of m symbols to a part of codes, and where that part ends (the first such end)."""
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, at = m, -1
    for i, c in enumerate(codes):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, at = score, i
    return best, at


class PieceIndex:
    """The pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.codes: dict[str, int] = {}
        self.items: list[tuple[int, list[int], int, dict[int, int]]] = []
        by_length: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        frequency: dict[int, int] = {}
        for item_id, text in items:
            coded = [self.codes.setdefault(w, len(self.codes)) for w in words(text or "")]
            if not coded:
                continue
            k, masks = int(len(coded) * error_rate), {}
            for i, c in enumerate(coded):
                masks[c] = masks.get(c, 0) | 1 << i
            for c in masks:
                frequency[c] = frequency.get(c, 0) + 1
            cuts = [len(coded) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = int(self._keys(np.array(coded[a:b]), b - a)[0])
                by_length.setdefault(b - a, {}).setdefault(key, []).append((len(self.items), a, b))
            self.items.append((item_id, coded, k, masks))
        self.lookups = [
            (n, np.array(sorted(table), np.uint64), {key: self._shapes(places, frequency) for key, places in table.items()})
            for n, table in sorted(by_length.items())
        ]

    def _shapes(self, places: list[tuple[int, int, int]], frequency: dict[int, int]) -> dict[tuple[int, int, int], dict[int, list[int]]]:
        """Items by (place of the piece, words, budget), then by second words; -1 stands for no second word."""
        shapes: dict[tuple[int, int, int], dict[int, list[int]]] = {}
        for item, a, b in places:
            _, coded, k, _ = self.items[item]
            rest = coded[:a] + coded[b:]
            second = {-1} if len(places) <= COMMON or len(rest) <= k else set(nsmallest(k + 1, rest, key=lambda c: (frequency[c], c)))
            by_word = shapes.setdefault((a, len(coded), k), {})
            for w in second:
                by_word.setdefault(w, []).append(item)
        return shapes

    @staticmethod
    def _keys(codes: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n consecutive codes."""
        c, out = codes.astype(np.uint64) + np.uint64(1), np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for j in range(n):
            out = (out + c[j : len(c) - n + 1 + j]) * _MULTIPLIER
            out ^= out >> np.uint64(29)
        return out

    def windows(self, codes: np.ndarray) -> dict[tuple[int, bytes], tuple[int, int]]:
        """(first, end) of the first place of each (item, words around a hit)."""
        found: dict[tuple[int, bytes], tuple[int, int]] = {}
        unknown = np.concatenate([[0], np.cumsum(codes < 0)])
        for n, keys, table in self.lookups:
            at = np.flatnonzero(unknown[n:] == unknown[:-n]) if len(codes) >= n else unknown[:0]
            if not len(at):
                continue
            hashed = self._keys(codes, n)[at]
            spot = np.searchsorted(keys, hashed)
            right = keys[np.minimum(spot, len(keys) - 1)] == hashed
            near: dict[tuple[int, int, int, int, bytes], set[int]] = {}
            for p, key in zip(at[right].tolist(), hashed[right].tolist(), strict=True):
                for (a, size, k), by_word in table[key].items():
                    first, end = max(0, p - a - k), min(len(codes), p - a + size + k)
                    around = codes[first:end].tobytes()
                    if (met := near.get((key, a, size, k, around))) is None:
                        met = near[key, a, size, k, around] = {i for w in {-1, *codes[first:end].tolist()} for i in by_word.get(w, ())}
                    for item in met:
                        if (known := found.get((item, around))) is None or first < known[0]:
                            found[item, around] = first, end
        return found

    def search(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """FOUND of one text's codes: for each item within its budget, the nearest place (the first of equals)."""
        best: dict[int, tuple[int, int]] = {}
        for (item, _), (first, end) in self.windows(codes).items():
            _, coded, k, masks = self.items[item]
            window, covered = codes[first:end].tolist(), 0
            for c in set(window):
                covered |= masks.get(c, 0)
            if covered.bit_count() < len(coded) - k:
                continue
            distance, at = myers(window, masks, len(coded))
            if distance <= k and (item not in best or (distance, first + at) < best[item]):
                best[item] = distance, first + at
        out = []
        for item, (distance, last) in best.items():
            item_id, coded, _, _ = self.items[item]
            back = {c: sum(1 << len(coded) - 1 - i for i in range(len(coded)) if m >> i & 1) for c, m in self.items[item][3].items()}
            _, length = myers(codes[max(0, last - 2 * len(coded)) : last + 1][::-1].tolist(), back, len(coded))
            out.append((item_id, len(coded), distance, last - length, last))
        return sorted(out)


_current: dict[tuple[str, int], PieceIndex] = {}


def _index(key: str, number: int, items: list[tuple[int, str]], error_rate: float) -> PieceIndex:
    """A block's index, built once in each Python worker as long as it is the only one; a worker holds one at a time."""
    if (key, number) not in _current:
        _current.clear()
        _current[key, number] = PieceIndex(items, error_rate)
    return _current[key, number]


def search_all(texts: list[str], blocks: list[list[tuple[int, str]]], key: str, error_rate: float) -> list[list[tuple[int, int, int, int, int]]]:
    """FOUND of each text in all blocks; texts are split into words once."""
    if len(blocks) == 1:
        index = _index(key, 0, blocks[0], error_rate)
        get = index.codes.get
        return [index.search(np.fromiter((get(w, -1) for w in found), np.int64, len(found))) for found in map(words, texts)]
    number: dict[str, int] = {}
    coded = [np.fromiter((number.setdefault(w, len(number)) for w in words(t)), np.int64) for t in texts]
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    for b, items in enumerate(blocks):
        index = _index(key, b, items, error_rate)
        here = np.fromiter((index.codes.get(w, -1) for w in number), np.int64, len(number))
        for hits, codes in zip(out, coded, strict=True):
            hits += index.search(here[codes])
    return [sorted(hits) for hits in out]


def finders(benchmark: DataFrame, error_rate: float = 0.2, block_bytes: int = 2 << 20, round_bytes: int = 32 << 20) -> Iterator[Callable]:
    """For each round of the benchmark (item_id, text) an Arrow function from texts to FOUND."""
    sc = benchmark.sparkSession.sparkContext

    def finder(blocks: list[list[tuple[int, str]]]) -> Callable:
        shared, key = sc.broadcast(blocks), uuid.uuid4().hex

        @F.arrow_udf(FOUND)
        def found(texts: pa.Array) -> pa.Array:
            hits = search_all([t or "" for t in texts.to_pylist()], shared.value, key, error_rate)
            rows = [[dict(zip(("item_id", "item_words", "distance", "first_word", "last_word"), hit, strict=True)) for hit in each] for each in hits]
            return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("item_words", pa.int32()), ("distance", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])))

        return found

    blocks, held, size = [[]], 0, 0
    for row in benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()).toLocalIterator():
        n = len((row["text"] or "").encode()) + 16
        if blocks[0] and held + n > round_bytes:
            yield finder(blocks)
            blocks, held, size = [[]], 0, 0
        if blocks[-1] and size + n > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], row["text"] or ""))
        held, size = held + n, size + n
    if blocks[0]:
        yield finder(blocks)


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.2, block_bytes: int = 2 << 20, round_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, item_words, distance, first_word, last_word: a row for each item that a document holds."""
    done, last = [], None
    for found in finders(benchmark, error_rate, block_bytes, round_bytes):
        if last is not None:  # the driver keeps one round at a time
            done.append(materialize(last))
        last = docs.select("doc_id", F.explode(found("text")).alias("_f")).select("doc_id", "_f.*")
    if last is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, item_words int, distance int, first_word long, last_word long")
    return reduce(DataFrame.unionByName, [*done, last])


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.2, block_bytes: int = 2 << 20, round_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, with their columns, that hold no item."""
    for k, found in enumerate(finders(benchmark, error_rate, block_bytes, round_bytes)):
        docs = (materialize(docs) if k else docs).where(F.size(found("text")) == 0)
    return docs
