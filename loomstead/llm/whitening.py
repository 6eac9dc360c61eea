"""Whitening of embeddings from an exact integer scatter.

1. Entries c become integers x = floor(1024 * c) + SHIFT; the shift is subtracted again, as no covariance depends on it.
2. Each task adds up n, the sums and the cross-products of its vectors exactly: entries are cut into digits of 20 bits,
   whose products a block's matrix product adds up without rounding, and whole numbers of any size hold the rest. They
   leave the task as digits of 30 bits, which Spark adds up; as many as the dimensions' pairs reach the driver.
3. n * X'X - S * S' is formed in whole numbers and only then divided and turned into doubles, for `eigh`.
4. A second pass projects every vector on the leading components; a third measures the covariance of what came out.

Vectors are left out that are null or empty, that hold null, NaN or infinite entries or one whose x is no long, or whose
dimension isn't the commonest (ties: the largest). Repeated rows count each time, rows without vec_id like others. A
component without variance (its eigenvalue is nothing but rounding) can't be scaled and is left out, so equal vectors,
or a single one, give no rows. Equal eigenvalues (ties) are numbered as `eigh` gives them. `deviation` is null where it
is no long; `deviation_exact` holds it up to 38 digits. Other columns, whatever their names, are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import materialize

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Vectors of a block: products of two 20-bit digits, added up over it, stay below 2^53.
BLOCK, DIGIT = 1 << 13, 20
#: Digits in which whole numbers leave a task.
PARTS, PART = 8, 30
_PART_NAMES = [f"d{k}" for k in range(PARTS)]
SUMS = "size int, i int, j int, " + ", ".join(f"{d} long" for d in _PART_NAMES)
WHITENED = "vec_id long, whitened array<double>, deviation decimal(38,0)"


def usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integers x - SHIFT) of the vectors of each dimension in column 1."""
    column = batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    entries = pc.list_flatten(column)  # null vectors have none
    values = entries.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        good = np.abs(scaled) < 2.0**63 - 2.0**20  # NaN and infinity aren't
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        at = start[rows][:, None] + np.arange(size)
        rows = rows[good[at].all(1)]
        if len(rows):
            yield rows, scaled[start[rows][:, None] + np.arange(size)].astype(np.int64)


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """y as signed digits of DIGIT bits, the lowest first, as doubles."""
    out, half = [], 1 << (DIGIT - 1)
    while True:
        low = ((y + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
        if not y.any():
            return out


def _block_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of y as whole numbers of any size."""
    digits = _digits(y)
    sums, cross = np.zeros(y.shape[1], object), np.zeros((y.shape[1],) * 2, object)
    for a, left in enumerate(digits):
        sums += left.sum(0).astype(np.int64).astype(object) << (DIGIT * a)
        for b, right in enumerate(digits):
            cross += (left.T @ right).astype(np.int64).astype(object) << (DIGIT * (a + b))
    return sums, cross


def _parts(value: int) -> list[int]:
    low = [(value >> (PART * k)) & ((1 << PART) - 1) for k in range(PARTS - 1)]
    return [*low, value >> (PART * (PARTS - 1))]


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and n * X'X - S * S' of the x - SHIFT of all usable vectors of the commonest dimension, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for rows, y in usable(batch):
                total = held.setdefault(y.shape[1], [0, 0, 0])
                total[0] += len(rows)
                for a in range(0, len(y), BLOCK):
                    sums, cross = _block_sums(y[a : a + BLOCK])
                    total[1], total[2] = total[1] + sums, total[2] + cross
        for size, (n, sums, cross) in held.items():
            keys = [(-1, -1, n), *((-1, j, sums[j]) for j in range(size)), *((i, j, cross[i, j]) for i in range(size) for j in range(i, size))]
            for a in range(0, len(keys), 1 << 16):
                part = keys[a : a + (1 << 16)]
                numbers = np.array([_parts(int(v)) for _, _, v in part], np.int64)
                ends = np.array([(size, i, j) for i, j, _ in part], np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, ends.T), *map(pa.array, numbers.T)], names=["size", "i", "j", *_PART_NAMES])

    partial = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, SUMS)
    rows = partial.groupBy("size", "i", "j").agg(*[F.sum(d).alias(d) for d in _PART_NAMES])
    whole = materialize(rows)
    counts = whole.where("i = -1 AND j = -1").collect()
    value = lambda r: sum(r[d] << (PART * k) for k, d in enumerate(_PART_NAMES))
    if not counts:
        return 0, [], []
    n, size = max((value(r), r["size"]) for r in counts)
    sums, cross = [0] * size, [[0] * size for _ in range(size)]
    for r in whole.where((F.col("size") == size) & (F.col("j") >= 0)).toLocalIterator():
        if r["i"] < 0:
            sums[r["j"]] = value(r)
        else:
            cross[r["i"]][r["j"]] = cross[r["j"]][r["i"]] = value(r)
    return n, sums, [[n * cross[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]


def components(n: int, scattered: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors (columns; the largest entry positive) and the trace of the covariance."""
    covariance = np.array([[v / (n * n) for v in row] for row in scattered], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    there = values > len(covariance) * np.finfo(np.float64).eps * max(values.max(initial=0.0), 0.0)
    values, vectors = values[there], vectors[:, there]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.shape[1] else np.ones(0)
    return values, vectors * signs, float(np.trace(covariance))


def projected(n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> Callable:
    """WHITENED of a partition's usable vectors of this dimension."""
    size, scaled, exact = len(sums), vectors / np.sqrt(values), np.array(sums, object)
    most = 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in usable(batch):
                if y.shape[1] != size:
                    continue
                # whole numbers of any size only where they don't fit
                bound = n * int(np.abs(y).max()) + max(map(abs, sums))
                apart = n * y - exact.astype(np.int64) if bound < most else n * y.astype(object) - exact
                squares = (apart**2).sum(1) if bound * bound * size < most else (apart.astype(object) ** 2).sum(1)
                # the quotient of whole numbers, rounded once
                centred = apart.astype(np.float64) / n if bound < 1 << 53 else np.array([[v / n for v in row] for row in apart.astype(object)], np.float64)
                out = centred @ scaled
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                ids = batch.column(0).take(pa.array(rows)).cast(pa.int64())
                shown = pa.array([_decimal(int(v)) for v in squares], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([ids, flat, shown], names=["vec_id", "whitened", "deviation"])

    return run


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value) if value < 10**38 else None


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of vectors (vec_id, embedding)."""
    n, sums, scattered = scatter(vectors)
    values, axes, trace = components(n, scattered, most) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    given = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    done = materialize(given.mapInArrow(projected(n, sums, values, axes), WHITENED))
    w = [F.col("whitened")[i] for i in range(len(values))]
    # co-moments are centred as they are added up
    moments = done.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i in range(len(w)) for j in range(i, len(w))]).first()
    error = max(abs(moments[f"c{i}_{j}"] - (i == j)) for i in range(len(w)) for j in range(i, len(w)))
    rows = done.select("vec_id", F.posexplode("whitened").alias("_p", "whitened"), "deviation")
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    fits = F.when(F.col("deviation") <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), F.col("deviation").cast("long"))
    return rows.select(
        "vec_id", (F.col("_p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), fits.alias("deviation"), "whitened",
        explained[F.col("_p")].alias("explained"), F.lit(float(error)).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
