"""Broadcast behind a size check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.session import ensure_checkpoint_dir

MAX_BROADCAST_ROWS = 200_000


def fits(rows: DataFrame, limit: int) -> bool:
    """Whether a frame has at most ``limit`` rows; reads no more than limit + 1."""
    return rows.limit(limit + 1).count() <= limit


def small_side(rows: DataFrame, small: bool) -> DataFrame:
    """Hint a broadcast for a side already known to be bounded.

    Without the hint the join is shuffled on its keys and adaptive execution
    splits skewed partitions.
    """
    return F.broadcast(rows) if small else rows


def broadcast_if_small(rows: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side counted to be small, else leave the join to Spark."""
    return small_side(rows, fits(rows, limit))


def cut(rows: DataFrame) -> DataFrame:
    """Materialise a result that several later steps read, in the shared checkpoint folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def materialise(rows: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared checkpoint folder and read it back.

    The table survives the loss of executors and is compressed, unlike a
    checkpoint. It lies below the folder named in ``spark.checkpoint.dir`` and
    goes when that folder is emptied.
    """
    path = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan that yields fewer splits than the session has cores.

    A small file is one split and would leave the cores idle in text-heavy
    work. A scan with enough splits, as on any large table, is left alone.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


SLICE_ROWS = 500


def in_slices(batches):
    """Arrow batches in slices, so that a task holds few rows as Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
