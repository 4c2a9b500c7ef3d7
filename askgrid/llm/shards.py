"""Two-pass external shuffle of records into shards of equal row counts.

First pass: every record goes to a bucket named by a seeded hash, uniformly
and independently of source, text or order; the number of buckets follows from
the bytes, so a bucket fits in memory. Second pass: each bucket is put in a
fixed order, permuted by a seeded Fisher-Yates shuffle and written. The
buckets one after the other form one uniformly random permutation of all
records; the shards are equal ranges of it, so their row counts differ by at
most one and a bucket feeds one or two shards.

The result depends on the data and the seed only, not on the number of
executors, so a lost task is repeated with the same outcome.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import fresh
from askgrid.session import ensure_checkpoint_dir

BUCKET_BYTES = 32 << 20
SEED = 20_240_517


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus eight for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8).cast("long")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A random permutation; numpy's ``shuffle`` is the Fisher-Yates exchange."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64(seed)).shuffle(order)
    return order


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = SEED,
                        bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot`` (from 0 without gaps in a shard).

    A column of ``docs`` named shard or slot is replaced. Null ids and texts are
    records like any other; an empty table gives no rows. Repeated rows of one
    id and text share a bucket. A bucket is read in the order of its hashes and
    permuted in stretches of at most ``2 * bucket_bytes``, so such rows never
    have to fit in memory; other buckets are one stretch.
    """
    kept = docs.drop("shard", "slot")
    bucket, place, tie = fresh(["bucket", "place", "tie"], kept.columns)
    hashable = [field.name for field in kept.schema if "map<" not in field.dataType.simpleString()
                and field.dataType.simpleString() not in ("variant", "void")]
    total = kept.agg(F.sum(record_size(F.col("text")))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    scattered = (kept.withColumn(place, F.xxhash64(F.lit(seed), "doc_id", "text"))
                 .withColumn(tie, F.xxhash64(*hashable))
                 .withColumn(bucket, F.pmod(F.shiftright(place, 20), F.lit(n)).cast("int")))
    counts = {row[0]: row[1] for row in scattered.groupBy(bucket).count().collect()}
    first, at = {}, 0  # one entry per bucket: total bytes / bucket_bytes
    for name in sorted(counts):
        first[name], at = at, at + counts[name]
    rows, small, larger = at, at // shards if shards else 0, at % shards
    names = kept.columns

    def shard_of(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``larger`` shards hold one row more than the others."""
        edge = larger * (small + 1)
        low = positions < edge
        shard = np.where(low, positions // (small + 1),
                         larger + (positions - edge) // max(small, 1))
        return shard, positions - (shard * small + np.minimum(shard, larger))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, current, done = [], 0, None, 0

        def flush():
            table = pa.Table.from_batches(held)
            order = fisher_yates(table.num_rows, [seed, current, done])
            shard, slot = shard_of(first[current] + done + np.arange(table.num_rows))
            table = table.take(pa.array(order)).select(names)
            table = (table.append_column("shard", pa.array(shard, pa.int32()))
                     .append_column("slot", pa.array(slot, pa.int64())))
            yield from table.to_batches(max_chunksize=2048)

        for batch in batches:
            buckets = batch.column(bucket).to_numpy()
            edges = np.flatnonzero(np.diff(buckets)) + 1
            for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(buckets)].tolist()):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if held and (buckets[a] != current or weight + part.nbytes > 2 * bucket_bytes):
                    yield from flush()
                    done += sum(item.num_rows for item in held)
                    held, weight = [], 0
                if buckets[a] != current:
                    current, done = int(buckets[a]), 0
                held.append(part)
                weight += part.nbytes
        if held:
            yield from flush()

    schema = kept.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).schema
    if not rows:
        return kept.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    return (scattered.repartitionById(n, F.col(bucket))
            .sortWithinPartitions(bucket, place, "doc_id", tie)
            .mapInArrow(run, schema))


def write_shards(docs: DataFrame, shards: int = 24, seed: int = SEED,
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards to the shared folder, one directory per shard, and read them back."""
    shuffled = shuffle_into_shards(docs, shards, seed, bucket_bytes)
    path = (f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}")
    shuffled.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(shuffled.schema).parquet(path)
