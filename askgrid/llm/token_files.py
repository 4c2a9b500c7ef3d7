"""Token files: ids under a canonical, length-limited Huffman code.

A token file set is a table in the shared folder with one row per block, plus
a table of code lengths. The code is canonical: codes of one length are
consecutive and ordered by id, so the lengths alone define it. A block holds
whole documents and can be decoded on its own; it stores its payload, the
token counts of its documents, and the bit offset of every ``STEP``-th token,
so reading may start at any of these checkpoints. Decoding is driven by one
table of ``2 ** max_bits`` entries and advances all checkpoints of a block at
once.

Ids are counted over all documents (counts are summed per task and then by
id). What reaches the driver is one count per distinct id, at most the size of
the vocabulary, and one row per output partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.common import materialise, task_count
from askgrid.llm.tokens import as_ids, token_table

MAX_BITS = 18
STEP = 256
BLOCK_TOKENS = 1 << 18
PARTITION_BYTES = 64 << 20
BLOCKS = ("part int, block int, first_token long, n_tokens long, doc_ids array<long>, "
          "doc_tokens array<long>, checkpoints binary, payload binary")


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` bits, by package-merge."""
    symbols = sorted(counts, key=lambda symbol: (counts[symbol], symbol))
    n = len(symbols)
    if n == 1:
        return {symbols[0]: 1}
    if n > 1 << max_bits:
        raise ValueError("Too many symbols for this code length")
    weights = np.array([counts[symbol] for symbol in symbols], np.float64)
    # Each level holds sorted packages; only which of them are leaves must be kept.
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < n)
        merged = merged[order]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    return {symbol: int(bits) for symbol, bits in zip(symbols, lengths)}


def canonical_codes(lengths: dict[int, int]) -> dict[int, int]:
    """Code of each symbol: by length, then by symbol."""
    codes, code, before = {}, 0, 0
    for symbol, bits in sorted(lengths.items(), key=lambda item: (item[1], item[0])):
        code <<= bits - before
        codes[symbol], before = code, bits
        code += 1
    return codes


class Code:
    """Arrays of a canonical code for vectorised encoding and decoding."""

    def __init__(self, lengths: dict[int, int]):
        size = max(lengths, default=0) + 1
        self.bits = np.zeros(size, np.int64)
        self.codes = np.zeros(size, np.uint64)
        self.width = max(lengths.values(), default=1)
        self.table = np.zeros(1 << self.width, np.int64)  # symbol << 6 | bits
        for symbol, code in canonical_codes(lengths).items():
            bits = lengths[symbol]
            self.bits[symbol], self.codes[symbol] = bits, code
            start = code << (self.width - bits)
            self.table[start:start + (1 << (self.width - bits))] = symbol << 6 | bits

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every ``step``-th token."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word, offset = starts >> 5, starts & 31
        shifted = self.codes[ids] << (64 - offset - bits).astype(np.uint64)
        words = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] |= np.bitwise_or.reduceat(shifted >> np.uint64(32), first)
        words[word[first] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        payload = words.astype(">u4").tobytes()[:(int(ends[-1]) + 7) // 8]
        return payload, starts[::step]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int,
               step: int = STEP) -> np.ndarray:
        """All ``n`` ids, every checkpoint advancing by one token at a time."""
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.int64)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((len(at), step), np.int64)
        mask = (1 << self.width) - 1
        last = n - (len(at) - 1) * step
        for k in range(step):
            if k == last:
                at = at[:-1]
            found = self.table[window[at >> 3] >> (32 - self.width - (at & 7)) & mask]
            out[:len(at), k] = found >> 6
            at += found & 63
        return out.reshape(-1)[:n]


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for width in pc.unique(batch.column(1)).to_pylist():
                own = batch.column(0).filter(pc.equal(batch.column(1), width)).to_pylist()
                more = np.bincount(as_ids(b"".join(own), width))
                if len(more) > len(seen):
                    seen, more = more, seen
                seen[:len(more)] += more
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seen[ids], pa.int64())],
                                         names=["id", "n"])

    counted = (tokens.select("ids", "width").mapInArrow(run, "id long, n long")
               .groupBy("id").agg(F.sum("n").alias("n")))
    return {row["id"]: row["n"] for row in counted.collect()}


def _blocks(code: Code, block_tokens: int):
    """Partition of (doc_id, ids, width) in order -> block rows."""

    def close(part, block, first, doc_ids, pieces):
        ids = np.concatenate(pieces)
        payload, checkpoints = code.encode(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()),
             pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
             pa.array([doc_ids], pa.list_(pa.int64())),
             pa.array([[len(piece) for piece in pieces]], pa.list_(pa.int64())),
             pa.array([checkpoints.astype("<i8").tobytes()], pa.binary()),
             pa.array([payload], pa.binary())],
            names=["part", "block", "first_token", "n_tokens", "doc_ids", "doc_tokens",
                   "checkpoints", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        block = first = held = 0
        doc_ids, pieces = [], []
        for batch in batches:
            for doc_id, raw, width in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids.append(doc_id)
                pieces.append(as_ids(raw, width))
                held += len(pieces[-1])
                if held >= block_tokens:
                    yield close(part, block, first, doc_ids, pieces)
                    block, first, held, doc_ids, pieces = block + 1, first + held, 0, [], []
        if pieces:
            yield close(part, block, first, doc_ids, pieces)

    return run


def write_token_files(docs: DataFrame, end_id: int = 2, tokenizer_path: str | None = None,
                      max_bits: int = MAX_BITS, block_tokens: int = BLOCK_TOKENS,
                      partition_bytes: int = PARTITION_BYTES) -> tuple[DataFrame, DataFrame]:
    """Encode all texts; (blocks, lengths), both tables in the shared folder.

    Blocks hold documents in ascending doc_id order (null ids first; rows with
    one id ordered by their ids' bytes), over range partitions of about
    ``partition_bytes`` of raw ids. An empty input gives empty tables.
    """
    spark = docs.sparkSession
    tokens = materialise(token_table(docs, end_id, tokenizer_path), "tokens")
    lengths = code_lengths(counts, max_bits) if (counts := count_ids(tokens)) else {}
    code = Code(lengths)
    parts = task_count(tokens, "ids", partition_bytes)
    # Rows of one doc_id, or without one, are spread by how their ids begin.
    ordered = (tokens.select("doc_id", "ids", "width")
               .repartitionByRange(parts, "doc_id", F.substring("ids", 1, 32))
               .sortWithinPartitions("doc_id", "ids"))
    blocks = materialise(ordered.mapInArrow(_blocks(code, block_tokens), BLOCKS), "token-blocks")
    table = materialise(spark.createDataFrame(sorted(lengths.items()), "id long, bits int"),
                        "token-code")
    return blocks, table


def read_token_files(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids binary) of every document in the files.

    ``ids`` are little-endian unsigned 32-bit; ``start`` counts the ids of all
    documents before. The code has at most one row per id of the vocabulary.
    """
    code = Code({row["id"]: row["bits"] for row in lengths.collect()})
    # One row per output partition.
    before = (blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("part", "before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = code.decode(row["payload"], np.frombuffer(row["checkpoints"], "<i8"),
                                  row["n_tokens"]).astype("<u4")
                ends = np.cumsum(np.array(row["doc_tokens"], np.int64))
                starts = ends - row["doc_tokens"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(ends), pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()),
                     pa.array(row["first_token"] + starts, pa.int64()),
                     pa.array(row["doc_tokens"], pa.int64()),
                     pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                    names=["part", "doc_id", "first", "n_tokens", "ids"])

    decoded = blocks.mapInArrow(run, "part int, doc_id long, first long, n_tokens long, ids binary")
    return (decoded.join(F.broadcast(before), "part")
            .select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids"))
