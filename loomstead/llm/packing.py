"""Packing documents into sequences of fixed length by shortest-pack-first over the length histogram.

Each document's ids, with an end id, are cut into full pieces and a remainder. Only the histogram of piece
lengths (at most `size` numbers) reaches the driver, which places lengths longest first and counts packing
patterns. Pieces then find their sequence by their rank among the pieces of their length. Null texts count as
empty: one piece with the end id. Repeated rows are packed each, with or without doc_id. Of pieces of one length (ties) the
order is that of their doc_id and start within hash buckets. Very long texts are cut into as many full pieces as they have. Other
columns of docs, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import materialize
from loomstead.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACES = "length long, first long, last long, copies long, sequence long, at long"


def cut(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """The pieces of each document: PIECES."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                out += [(doc_id, s, min(size, len(ids) - s), zlib.crc32(ids[s : s + size]), len(ids)) for s in range(0, len(ids), size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as ([(length, how often in a sequence)], number of sequences), from the number of pieces by length.

    Longest first, each length goes to the packs that are shortest so far; what fits in none begins new packs.
    """
    packs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    room_left = np.zeros(size + 1, bool)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(room_left[length:])
            if not len(fits):
                break
            room = int(fits[-1]) + length
            pattern, count = packs[room].pop()
            if not packs[room]:
                room_left[room] = False
            each = min(room // length, max(1, left // count))
            used = min(count, left // each)
            if used < count:
                packs[room].append((pattern, count - used))
                room_left[room] = True
            packs.setdefault(room - each * length, []).append((pattern + [(length, each)], used))
            room_left[room - each * length] = True
            left -= used * each
        each = size // length
        for n, times in ((each, left // each), (left % each, 1)):
            if n and times and left:
                packs.setdefault(size - n * length, []).append(([(length, n)], times))
                room_left[size - n * length] = True
    return [x for room in sorted(packs) for x in packs[room]]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, ...]]:
    """PLACES: which ranks of each length go to which sequences. Far fewer than pieces: some for each pattern."""
    out, used, sequence = [], {}, 0
    for pattern, count in patterns:
        at = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            used[length] = first + count * copies
            out.append((length, first, used[length] - 1, copies, sequence, at))
            at += length * copies
        sequence += count
    return out


def ranked(pieces: DataFrame, total: int, per_bucket: int = 100_000) -> DataFrame:
    """pieces with rank, from 0 without gaps among the pieces of a length, whatever share of all pieces has it.

    Each length is dealt by hash over buckets; a bucket's first rank is the sum of the counts before it.
    """
    buckets = max(64, total // per_bucket)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    pieces = materialize(cut(docs, path, size, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(pack_histogram(histogram, size))
    rows = spark.createDataFrame(table, PLACES)
    if len(table) <= 64 * size:  # always so; a plan beyond it is shuffled like any table
        rows = F.broadcast(rows)
    step = F.col("rank") - F.col("first")
    joined = ranked(pieces, sum(histogram.values())).join(rows, "length").where(F.col("rank").between(F.col("first"), F.col("last")))
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(step / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + F.col("length") * (step % F.col("copies"))).alias("offset"),
    )
