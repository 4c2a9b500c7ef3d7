"""Document quality by a factorisation machine.

Inputs of a score: hashed lower-case words (relative frequencies, scaled to
unit length), structure statistics of the text (shares of byte classes, word
and line statistics) and its length, each statistic as one of a few bins. The
language, source, id and labels of a document are never inputs. The machine
models all pairwise interactions through low-rank factors,

    y = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

which is linear in the number of non-zero inputs.

It is fitted on the driver with Adam on at most ``TRAIN_ROWS`` labelled rows,
those with the least seeded hash of their id. The driver receives their hashed
inputs, not their texts, so a row is bounded by the number of buckets. All
other work is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import fresh

TRAIN_ROWS = 6_000
WORD_BUCKETS = 2048
BINS = 8
FACTORS = 8
EPOCHS = 25
BATCH = 200
SEED = 20_240_601
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """Structure statistics of one text; all zero for an empty one."""
    if not raw:
        return [0.0] * (len(PUNCTUATION) + 11)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, n_words = len(raw), max(len(words), 1)
    lines = raw.split(b"\n")
    shares = (counts[list(PUNCTUATION)] / n_words).tolist()
    return shares + [
        np.log1p(n), np.log1p(len(words)), n / n_words, len(set(words)) / n_words,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(len(lines)),
        counts[65:91].sum() / n, counts[48:58].sum() / n, counts[128:].sum() / n,
        counts[[9, 13, 32]].sum() / n]


def word_inputs(words: list[bytes], buckets: int = WORD_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length frequencies of the hashed words."""
    import xxhash
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    hashed = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % buckets
    counts = np.bincount(hashed, minlength=buckets)
    found = np.flatnonzero(counts)
    weights = np.log1p(counts[found])
    return found, (weights / np.linalg.norm(weights)).astype(np.float32)


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values, and the statistics of one text."""
    words = raw.lower().split()
    return *word_inputs(words), np.array(statistics(raw, words))


@dataclass
class Machine:
    """Parameters of a fitted factorisation machine."""

    edges: np.ndarray    # (statistics, BINS - 1) bin edges
    bias: float
    weights: np.ndarray  # (inputs,)
    factors: np.ndarray  # (inputs, FACTORS)

    def inputs(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of the non-zero inputs of one text."""
        return self.placed(*features(raw))

    def placed(self, found: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the features of a text."""
        bins = (stats[:, None] > self.edges).sum(axis=1)
        place = WORD_BUCKETS + np.arange(len(stats)) * BINS + bins
        return (np.concatenate([found, place]),
                np.concatenate([values, np.full(len(stats), len(stats) ** -0.5, np.float32)]))

    def score(self, raw: bytes) -> float:
        """Probability of the label 1."""
        at, x = self.inputs(raw)
        scaled = self.factors[at] * x[:, None]
        pairs = 0.5 * float((scaled.sum(axis=0) ** 2 - (scaled ** 2).sum(axis=0)).sum())
        margin = self.bias + float(self.weights[at] @ x) + pairs
        return float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))


def bin_edges(stats: np.ndarray) -> np.ndarray:
    """Quantiles of each statistic, the outer bins narrow, so that rare values stand apart."""
    quantiles = [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98]
    return np.quantile(stats, quantiles, axis=0).T if len(stats) else np.zeros((stats.shape[1], BINS - 1))


def fit(rows: list[tuple], labels: list[int], factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = 0.02, decay: float = 1e-4, seed: int = SEED) -> Machine:
    """Fit on the features of labelled texts; without any, every score is one half."""
    rng = np.random.Generator(np.random.PCG64(seed))
    stats = np.array([row[2] for row in rows]).reshape(len(rows), len(PUNCTUATION) + 11)
    size = WORD_BUCKETS + stats.shape[1] * BINS
    machine = Machine(bin_edges(stats), 0.0, np.zeros(size, np.float32),
                      (0.05 * rng.standard_normal((size, factors))).astype(np.float32))
    if not rows:
        machine.factors[:] = 0
        return machine
    matrix = np.zeros((len(rows), size), np.float32)
    for line, row in zip(matrix, rows):
        at, x = machine.placed(*row)
        line[at] = x
    target = np.array(labels, np.float32)
    state = {name: [np.zeros_like(value), np.zeros_like(value)] for name, value in
             (("b", np.zeros(1, np.float32)), ("w", machine.weights), ("v", machine.factors))}
    bias, step = np.zeros(1, np.float32), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), BATCH):
            x, y = matrix[order[begin:begin + BATCH]], target[order[begin:begin + BATCH]]
            sums = x @ machine.factors
            squares = x * x
            margin = bias + x @ machine.weights + 0.5 * (
                (sums ** 2).sum(axis=1) - squares @ (machine.factors ** 2).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
            gradients = {
                "b": np.array([error.sum()]), "w": x.T @ error + decay * machine.weights,
                "v": x.T @ (error[:, None] * sums) - (squares.T @ error)[:, None] * machine.factors
                + decay * machine.factors}
            step += 1
            for name, value in (("b", bias), ("w", machine.weights), ("v", machine.factors)):
                mean, spread = state[name]
                mean += 0.1 * (gradients[name] - mean)
                spread += 0.001 * (gradients[name] ** 2 - spread)
                value -= (rate * (mean / (1 - 0.9 ** step))
                          / (np.sqrt(spread / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    machine.bias = float(bias[0])
    return machine


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows that are not held out.

    Rows with the least seeded hash of their id come first; an id with several
    labels takes the largest. The sample is bounded by ``limit``, so it is broadcast.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(limit))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Machine:
    """Fit on the bounded sample; repeated ids give repeated rows, cut to ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(raw) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            packed = [pa.array([np.asarray(row[k], kind).tobytes() for row in found], pa.binary())
                      for k, kind in enumerate(("<i8", "<f4", "<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed],
                                             names=["doc_id", "label", "found", "weights", "stats"])

    sample = training_rows(docs, labels, "quality", limit).select("doc_id", "text", "label")
    rows = (sample.mapInArrow(run, "doc_id long, label int, found binary, weights binary, stats binary")
            .orderBy("doc_id", "found", "weights", "stats").limit(limit).collect())
    return fit([(np.frombuffer(row["found"], "<i8"), np.frombuffer(row["weights"], "<f4"),
                 np.frombuffer(row["stats"], "<f8")) for row in rows], [row["label"] for row in rows])


def with_quality(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1, higher is better); null texts count as empty."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the number of inputs

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        return pd.Series([model.value.score((text or "").encode()) for text in texts])

    return docs.withColumn(column, score(F.col("text")))


def drop_low_quality(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """``docs`` that score at least ``threshold``; all columns stay."""
    (name,) = fresh(["quality_score"], docs.columns)
    return with_quality(docs, machine, name).where(F.col(name) >= threshold).drop(name)
