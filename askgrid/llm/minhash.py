"""Near-duplicate documents by MinHash with sequential Bayesian verification.

A document is the set of its distinct ``SHINGLE``-word runs. Documents are
linked when the Jaccard similarity of their sets reaches a threshold; a
component of linked documents is named by its smallest doc_id.

1. Sketch: one pass computes each set's size, a 128-bit hash of the whole set,
   ``BANDS * ROWS`` minima, their band keys and one byte of each minimum.
2. Classes: equal sets collapse to the smallest doc_id, combined before the
   shuffle, so a group of copies of any size is one node from here on.
3. Candidates: nodes that share a band key form a bucket; buckets with equal
   members count once.
4. Verification: the signature bytes of a pair are compared in batches; after
   each the pair is dropped when the posterior probability that its similarity
   reaches the threshold is below ``MISS``. Survivors are verified on their
   full sets of words, taken from the texts.
5. Buckets are settled by ``settle``: star rounds link every node outside of its
   bucket's largest component with one star in it and one outside, and merge the
   components. What the rounds leave is paired completely over blocks bounded in
   rows and bytes, where only nodes outside of the largest component are copied.
   A first pass over signatures alone finds the nodes with surviving partners in
   other components; only those bring their texts along for a second one, which
   compares hashes of the word runs and confirms each link it returns on the
   words. No link between components is lost, and large groups of near copies
   are not paired with themselves.

With 25 bands of 5 rows a pair at similarity 0.85 escapes all buckets with a
probability below 1e-6.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm import settle
from askgrid.llm.common import fresh, materialise
from askgrid.operators.bounded import broadcast_if_small

SHINGLE = 5
BANDS, ROWS = 25, 5
BATCH = 25
MISS = 1e-6
MAX_BROADCAST_IDS = 500_000
SKETCH = ("doc_id long, n_shingles long, set_hi long, set_lo long, signature binary, "
          "bands array<long>")


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word runs; bytes are UTF-8, A-Z are lowered."""
    import xxhash
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    runs = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        runs = _mix(runs * np.uint64(0xD6E8FEB86659FD93) + hashed[k:k + len(runs)])
    return np.unique(runs)


def shingle_set(raw: bytes, width: int = SHINGLE) -> set:
    """The runs themselves, for exact verification."""
    words = raw.lower().split()
    width = min(width, len(words))
    return set(zip(*(words[k:] for k in range(width)))) if words else set()


@functools.lru_cache(maxsize=4)
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(7_919))
    a = random.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], random.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """Least value of each of ``n`` linear hash functions over a non-empty set."""
    a, b = _coefficients(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, k:k + 2048] * a + b).min(axis=1))
    return least >> np.uint64(24)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """One sketch per document; without words the hashes and signature are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(),
                                   batch.column(1).cast(pa.binary()).to_pylist()):
                found = shingle_hashes(raw or b"", width)
                if not len(found):
                    out.append((doc_id, 0, None, None, None, None))
                    continue
                high, low = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist()
                least = minima(found, bands * rows)
                keys = np.arange(bands, dtype=np.uint64)
                for k in range(rows):
                    keys = _mix(keys * np.uint64(0xA0761D6478BD642F) + least[k::rows])
                bytes_ = (_mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()
                out.append((doc_id, len(found), high, low, bytes_, keys.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
                "doc_id", "n_shingles", "set_hi", "set_lo", "signature", "bands"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, SKETCH))


def posterior_reaches(matches: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold) after ``matches`` of ``compared``, uniform prior.

    The posterior is Beta(matches + 1, compared - matches + 1), whose upper
    tail is the probability of at most ``matches`` successes in compared + 1.
    """
    n = compared + 1
    return math.fsum(math.comb(n, k) * threshold ** k * (1 - threshold) ** (n - k)
                     for k in range(matches + 1))


def least_matches(n: int, threshold: float, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, matches needed to go on) after each batch of signature values."""
    return [(k, next(m for m in range(k + 1) if posterior_reaches(m, k, threshold) >= miss))
            for k in [*range(batch, n, batch), n]]


def surviving(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the signature rows that pass every batch."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for compared, needed in steps:
        matches = matches + (left[alive, done:compared] == right[alive, done:compared]).sum(axis=1)
        keep = matches >= needed
        alive, matches, done = alive[keep], matches[keep], compared
    return alive


def _matrix(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def prune(pairs: DataFrame, nodes: DataFrame, threshold: float, n: int) -> DataFrame:
    """Pairs (a, b) that the sequential comparison of their signatures keeps."""
    steps = least_matches(n, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = surviving(_matrix(batch.column(2), n), _matrix(batch.column(3), n), steps)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
            .mapInArrow(run, "a long, b long").distinct())


def reaches(one: set, two: set, percent: int) -> bool:
    """100 * |intersection| >= percent * |union|; empty sets are like nothing."""
    shared = len(one & two)
    return bool(shared) and 100 * shared >= percent * (len(one) + len(two) - shared)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of some documents, as a table."""
    return materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
        .join(broadcast_if_small(ids, MAX_BROADCAST_IDS), "doc_id", "left_semi"), "near-texts")


def verify(pairs: DataFrame, texts: DataFrame, percent: int, width: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; ``texts`` has (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                left, right = (batch.column(k)[i].as_buffer().to_pybytes() for k in (2, 3))
                if known[0] != right:
                    known = right, shingle_set(right, width)
                if reaches(shingle_set(left, width), known[1], percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"))
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def open_rows(rows: DataFrame, nodes: DataFrame, threshold: float, n: int,
              block_rows: int = settle.BLOCK_ROWS) -> DataFrame:
    """The rows (bucket, node, label, major) with a partner in another label whose signature survives."""
    steps = least_matches(n, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = None, ["bucket", "node", "label", "major"]
        for table, copies in settle.blocks(batches):
            if table is not known:
                known = table
                node, label, major = (table.column(k).to_numpy() for k in ("node", "label", "major"))
                signature = _matrix(table.column("signature"), n)
            own, at_home, abroad = _matrix(copies.column("signature"), n), set(), []
            for row in range(copies.num_rows):
                others = settle.partners(table, copies, row, label, node, major)
                alive = surviving(np.broadcast_to(own[row], (len(others), n)), signature[others], steps)
                if len(alive):
                    at_home.update(others[alive].tolist())
                    abroad.append(row)
            yield from table.select(wanted).take(pa.array(sorted(at_home), pa.int64())).combine_chunks().to_batches()
            yield copies.select(wanted).take(pa.array(abroad, pa.int64()))

    payload = nodes.select("node", "signature", F.octet_length("signature").cast("long").alias("size"))
    return (settle.deal(rows, payload, "size", block_rows)
            .mapInArrow(run, "bucket long, node long, label long, major long").distinct())


def block_links(rows: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, n: int,
                width: int = SHINGLE, block_rows: int = settle.BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between labels of a bucket; one for each node and other label suffices."""
    steps = least_matches(n, percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for table, copies in settle.blocks(batches):
            if table is not known:
                known, sets = table, {}
                node, label, major = (table.column(k).to_numpy() for k in ("node", "label", "major"))
                signature, raw = _matrix(table.column("signature"), n), table.column("text").combine_chunks()
            own, links = _matrix(copies.column("signature"), n), []
            for row in range(copies.num_rows):
                others = settle.partners(table, copies, row, label, node, major)
                others = others[surviving(np.broadcast_to(own[row], (len(others), n)), signature[others], steps)]
                if not len(others):
                    continue
                mine = copies.column("text")[row].as_buffer().to_pybytes()
                hashes, done = shingle_hashes(mine, width), set()
                # The most alike first: one link into a label is enough.
                for k in others[np.argsort(-(signature[others] == own[row]).sum(axis=1), kind="stable")].tolist():
                    if label[k] in done:
                        continue
                    if k not in sets:
                        sets[k] = shingle_hashes(raw[k].as_buffer().to_pybytes(), width)
                    shared = len(np.intersect1d(hashes, sets[k], assume_unique=True))
                    if shared and 100 * shared >= percent * (len(hashes) + len(sets[k]) - shared) and reaches(
                            shingle_set(mine, width), shingle_set(raw[k].as_buffer().to_pybytes(), width), percent):
                        links.append((copies.column("node")[row].as_py(), int(node[k])))
                        done.add(label[k])
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    payload = (nodes.select("node", "signature").join(texts.withColumnRenamed("doc_id", "node"), "node")
               .withColumn("size", F.octet_length("text").cast("long")))
    return settle.deal(rows, payload, "size", block_rows).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE,
                    rounds: int = settle.ROUNDS, block_rows: int = settle.BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``; other columns are not read.

    Words are runs without white space, A-Z lowered; a text of fewer words
    than ``width`` is one run of them all; a null text or one without words is
    linked with nothing. Rows with words that share a doc_id are one document:
    all that is linked with one of them is linked with the others, and they are
    kept or dropped together. A null doc_id is its own component, kept, with a
    null component_id. An empty table gives no rows.
    """
    n, threshold = bands * rows, percent / 100
    sketch = materialise(sketches(docs, bands, rows, width), "near-sketches")
    named = sketch.where("set_hi IS NOT NULL AND doc_id IS NOT NULL")
    # Two classes may have one least doc_id; they are one document, and any text of it may link it.
    classes = materialise(
        named.groupBy("set_hi", "set_lo").agg(
            F.min("doc_id").alias("node"),
            F.min_by(F.struct("signature", "bands"), "doc_id").alias("best"))
        .select("set_hi", "set_lo", "node", "best.signature", "best.bands"), "near-classes")
    buckets = settle.distinct_buckets(classes.select("node", F.explode("bands").alias("bucket")).distinct(), "near")
    nodes = materialise(classes.join(buckets.select("node").distinct(), "node", "left_semi")
                        .select("node", "signature"), "near-nodes")
    texts = texts_of(docs, nodes.select(F.col("node").alias("doc_id")).distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        return verify(materialise(prune(pairs, nodes, threshold, n), "near-candidates"), texts, percent, width)

    def across(left: DataFrame) -> DataFrame:
        opened = materialise(open_rows(left, nodes, threshold, n, block_rows), "near-unsettled")
        return block_links(opened, nodes, texts, percent, n, width, block_rows)

    labels = settle.settle(buckets, linked, across, "near", rounds)
    return settle.named_components(sketch.select("doc_id", "n_shingles", "set_hi", "set_lo"),
                            classes.select("set_hi", "set_lo", "node"), labels).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each component, the one of the least doc_id; all columns stay.

    Rows without words, with a null text or a null doc_id stay; repeated rows of
    one doc_id are kept or dropped together. An empty table stays empty. Columns
    of ``docs`` may have any names.
    """
    (gone,) = fresh(["gone"], docs.columns)
    dropped = materialise(near_duplicates(docs, percent).where("NOT kept")
                          .select(F.col("doc_id").alias(gone)).distinct(), "near-gone")
    return docs.join(broadcast_if_small(dropped, MAX_BROADCAST_IDS),
                     F.col("doc_id").cast("long") == F.col(gone), "left_anti")
