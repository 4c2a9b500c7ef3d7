"""Whitening of embedding vectors from exact integer cross-products.

Entries become integers ``floor(64 * c) + 1000000``. The covariance is taken
over the distinct integer vectors:

1. One aggregate gives, for every dimension, the least and greatest value and
   the sum.
2. Bit-sliced scatter: a task shifts each dimension by its least value, packs
   every bit of the shifted values across rows into 64-bit words, and the
   AND of two bit planes, counted and weighted by the powers of two of both,
   is their part of ``sum(y_i * y_j)``. Tasks return one number per pair of
   dimensions, in limbs, which Spark adds up: no vector reaches the driver.
3. The driver centres the few exact sums as integers (``n * sum(xy) - S S``),
   divides once by ``n * n`` and takes eigenvectors with ``eigh``.

Only the matrix of the dimensions and the eigenvectors are on the driver and in
the tasks; their size depends on the dimensions, not on the rows.

Rows whose vector is null, holds null or non-finite entries, or has fewer
entries than the longest vector are dropped. ``64 * c`` beyond 2**60 in size
counts as 2**60. Rows of equal vectors all come back; the fit counts them once.
Components whose eigenvalue is not above 1e-12 of the trace do not exist: with a
single distinct vector, or an empty table, there are no rows. ``deviation`` is
null where it exceeds 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import fresh, materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
BLOCK = 8192
LIMB = 31
LEAST_SHARE = 1e-12
FAR = float(1 << 60)


def integers(embedding: Column) -> Column:
    """The integer vector of an embedding; null where it has null or non-finite entries."""
    good = F.forall(embedding, lambda c: F.coalesce(
        ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(embedding, lambda c: F.floor(F.greatest(F.least(
        c.cast("double") * SCALE, F.lit(FAR)), F.lit(-FAR))) + OFFSET))


def rows_of(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    """The vectors of one Arrow batch as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def cross_counts(shifted: np.ndarray, bits: list[int]) -> list[list[int]]:
    """Exact sums of products of all pairs of columns of non-negative integers.

    ``bits`` is the number of bit planes of each column.
    """
    size, words = len(bits), -(-len(shifted) // 64)
    padded = np.zeros((words * 64, size), np.int64)
    padded[:len(shifted)] = shifted
    planes = [(d, b) for d in range(size) for b in range(bits[d])]
    totals = [[0] * size for _ in range(size)]
    if not planes:
        return totals
    packed = np.stack([np.packbits(((padded[:, d] >> b) & 1).astype(np.uint8)).view(np.uint64) for d, b in planes])
    first = np.cumsum([0, *bits])
    for k, (d, b) in enumerate(planes):
        both = np.bitwise_count(packed[k:] & packed[k]).sum(axis=1, dtype=np.int64).tolist()
        for other in range(d, size):
            # Pairs of planes of one column count in both orders.
            for c in range(b if other == d else 0, bits[other]):
                value = both[first[other] + c - k] << (b + c)
                totals[d][other] += value * (2 if other == d and c > b else 1)
    return totals


@dataclass(frozen=True)
class Whitener:
    """Fit of a table; ``axes`` has one scaled eigenvector per column."""

    n: int
    least: tuple[int, ...]
    sums: tuple[int, ...]
    wide: bool
    axes: np.ndarray
    explained: tuple[float, ...] = ()
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S as integers, whitened values); ``sums`` are those of the shifted values."""
        shifted = x - np.array(self.least, np.int64)
        kind = object if self.wide else np.int64
        exact = shifted.astype(kind) * self.n - np.array(self.sums, kind)
        centred, values = (exact / self.n).astype(float), np.zeros((len(x), self.axes.shape[1]))
        for column, axis in zip(centred.T, self.axes):  # in one order, so equal vectors give equal values
            values += column[:, None] * axis
        return exact, values


def _scatter(fit: DataFrame, least: list[int], bits: list[int]) -> list[list[int]]:
    """Exact sums of products of the shifted columns over the whole table."""
    size = len(least)
    limbs = -(-(2 * max(bits) + 64) // LIMB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * size for _ in range(size)]
        for batch in batches:
            values = rows_of(batch, 0, size) - np.array(least, np.int64)
            for at in range(0, len(values), BLOCK):
                part = cross_counts(values[at:at + BLOCK], bits)
                total = [[a + b for a, b in zip(x, y)] for x, y in zip(total, part)]
        cells = [(i, j, k, (total[i][j] >> (LIMB * k)) & ((1 << LIMB) - 1))
                 for i in range(size) for j in range(i, size) for k in range(limbs) if total[i][j] >> (LIMB * k)]
        columns = list(zip(*cells)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["i", "j", "limb", "value"])

    found = (fit.select("x").mapInArrow(run, "i int, j int, limb int, value long")
             .groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect())
    total = [[0] * size for _ in range(size)]
    for row in found:
        total[row.i][row.j] += row.value << (LIMB * row.limb)
    return [[total[min(i, j)][max(i, j)] for j in range(size)] for i in range(size)]


def _identity_error(fit: DataFrame, fitted: Whitener) -> float:
    """Largest entry of the whitened fit list's covariance, centred, less the identity."""
    size, k = fitted.axes.shape

    def moments(means: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if means is None else k * k)
            for batch in batches:
                values = fitted.project(rows_of(batch, 0, size))[1]
                total += values.sum(axis=0) if means is None else ((values - means).T @ (values - means)).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["cell", "value"])

        found = (fit.select("x").mapInArrow(run, "cell int, value double")
                 .groupBy("cell").agg(F.sum("value").alias("value")).collect())
        out = np.zeros(k if means is None else k * k)
        for row in found:
            out[row.cell] = row.value
        return out / fitted.n

    return float(np.abs(moments(moments(None)).reshape(k, k) - np.eye(k)).max())


def fit_whitener(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit over the distinct vectors of a frame with the integer column ``x``; null without components."""
    fit = materialise(vectors.select("x").distinct(), "whitening-fit")
    ranges = (fit.select(F.posexplode("x").alias("at", "v")).groupBy("at")
              .agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"),
                   F.sum(F.col("v").cast("decimal(38,0)")).alias("total")).orderBy("at").collect())
    if not ranges:
        return None
    n, least = ranges[0].n, [row.least for row in ranges]
    bits = [(row.most - row.least).bit_length() for row in ranges]
    if not any(bits):
        return None
    cross = _scatter(fit, least, bits)
    moved = [int(row.total) - n * low for row, low in zip(ranges, least)]
    size = len(least)
    covariance = np.array([[(n * cross[i][j] - moved[i] * moved[j]) / (n * n) for j in range(size)]
                           for i in range(size)])
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1][:components]
    trace = sum((n * cross[i][i] - moved[i] ** 2) for i in range(size)) / (n * n)
    order = [k for k in order if values[k] > LEAST_SHARE * trace]
    # Beyond 63 bits the exact values are Python integers.
    wide = sum((n * (row.most - low)) ** 2 for row, low in zip(ranges, least)) >= 1 << 63
    scaled = axes[:, order] / np.sqrt(values[order])
    fitted = Whitener(n, tuple(least), tuple(moved), wide, scaled, tuple(float(values[k]) / trace for k in order))
    return replace(fitted, identity_error=_identity_error(fit, fitted))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), for every row and component."""
    spark = vectors.sparkSession
    (x,) = fresh(["x"], [id_column])
    kept = (vectors.select(F.col(id_column).cast("long").alias(id_column), integers(F.col(embedding)).alias(x))
            .where(F.size(x) > 0))
    longest = kept.agg(F.max(F.size(x))).first()[0]
    kept = kept.where(F.size(x) == F.lit(longest))
    fitted = fit_whitener(kept.select(F.col(x).alias("x")), components)
    schema = (f"`{id_column}` long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if fitted is None or not fitted.explained:
        return spark.createDataFrame([], schema)
    size, found = len(fitted.least), fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.explained)
        for batch in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            exact, values = found.project(rows_of(batch, 1, size))
            squares = (exact * exact).sum(axis=1).tolist()
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, found.n)),
                pa.array([None if v >= 1 << 63 else v for v in squares for _ in range(k)], pa.int64()),
                pa.array(values.ravel()), pa.array(np.tile(np.array(found.explained), rows)),
                pa.array(np.full(rows * k, found.identity_error)),
            ], names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.select(id_column, x).mapInArrow(run, schema)
