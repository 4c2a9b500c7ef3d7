"""A hash-chained journal that a stream appends to: resumable, idempotent, with one writer.

Layout below the journal's path:
  owner/checkpoint.txt     the checkpoint of the only stream that may append
  entries/batch_id=N/      (run, position, record, previous_sha, sha, appended)
  receipts/batch_id=N/     (run, first_position, last_position, entries, sha)

The last position and hash of each run are the stream's state, so a restart
continues every chain where it ended. A batch is written to its own folder with
overwrite: one that is repeated after a failure replaces itself.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

ENTRY_SCHEMA = "run long, position long, record string, previous_sha string, sha string, appended boolean"


class JournalHeld(RuntimeError):
    """Another stream writes this journal."""


def _owner(spark: SparkSession, path: str) -> str:
    row = spark.read.text(f"{path}/owner/checkpoint.txt", wholetext=True).first()
    return row[0] if row else ""


def claim(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Become the journal's writer, or go on being it; raise :class:`JournalHeld` if another one is.

    The file system creates the owner file once. Two processes with the same
    checkpoint are told apart by Spark's own log of that checkpoint.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/owner/checkpoint.txt")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        try:
            out = files.create(target, False)
        except Py4JJavaError:
            if not files.exists(target):
                raise
        else:
            out.write(checkpoint.encode())
            out.close()
    holder = _owner(spark, path)
    if holder != checkpoint:
        raise JournalHeld(f"The journal is written from {holder!r}")


def chained_stream(entries: DataFrame) -> DataFrame:
    """Chain a stream of (run, position, record) entries, each run in order of its positions.

    An entry at or before the last position of its run was delivered again, or
    too late to be chained: it is kept with ``appended`` false and no hashes. So
    is one of several entries at one position but the least record, and one
    without a run or position. A missing record counts as empty. What one
    trigger reads of a run is sorted in one task; bound it at the source with
    ``maxFilesPerTrigger``.
    """
    def extend(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["position", "record"], kind="stable")
        run = key[0]
        last, sha = state.get if state.exists else (None, hashlib.sha256(f"run {run}".encode()).hexdigest())
        out = []
        for position, record in zip(rows["position"], rows["record"]):
            if run is None or pd.isna(run) or pd.isna(position):
                out.append((run, position, record, None, None, False))
            elif last is not None and position <= last:
                out.append((run, int(position), record, None, None, False))
            else:
                before, last = sha, int(position)
                sha = hashlib.sha256((before + record).encode()).hexdigest()
                out.append((run, last, record, before, sha, True))
        if last is not None:
            state.update((last, sha))
        frame = pd.DataFrame(out, columns=[item.split()[0] for item in ENTRY_SCHEMA.split(", ")])
        yield frame.astype({"run": "Int64", "position": "Int64"})

    return (entries.select(F.col("run").cast("long").alias("run"), F.col("position").cast("long").alias("position"),
                           F.coalesce("record", F.lit("")).alias("record"))
            .groupBy("run").applyInPandasWithState(
                extend, ENTRY_SCHEMA, "last long, sha string", "append", GroupStateTimeout.NoTimeout))


def receipts_of(journal: DataFrame) -> DataFrame:
    """What each batch appended to each run: its range, its number of entries, the last hash."""
    return journal.where("appended").groupBy("run", "batch_id").agg(
        F.min("position").alias("first_position"), F.max("position").alias("last_position"),
        F.count(F.lit(1)).alias("entries"), F.max_by("sha", "position").alias("sha"))


def append_available(entries: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the source holds beyond the last run of this stream, and stop.

    A receipt is written after its entries, from what was written.
    """
    spark = entries.sparkSession
    claim(spark, path, checkpoint)

    def write(batch, batch_id):
        if _owner(spark, path) != checkpoint:
            raise JournalHeld(f"The journal at {path} has another writer")
        target = f"{path}/entries/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.schema(ENTRY_SCHEMA).parquet(target).withColumn("batch_id", F.lit(batch_id))
        receipts_of(written).drop("batch_id").write.mode("overwrite").parquet(f"{path}/receipts/batch_id={batch_id}")

    stream = (chained_stream(entries).writeStream.foreachBatch(write)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    stream.awaitTermination()


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ENTRY_SCHEMA}, batch_id long").parquet(f"{path}/entries")


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run long, first_position long, last_position long, entries long, sha string, "
                             "batch_id long").parquet(f"{path}/receipts")


def check_receipts(journal: DataFrame, receipts: DataFrame) -> DataFrame:
    """(run, batch_id, held): whether the journal still is what the receipt says.

    This finds entries cut off a chain's end, which leave the chain itself
    whole, and entries or batches without a receipt.
    """
    keys = ["run", "batch_id"]
    facts = F.struct("first_position", "last_position", "entries", "sha")
    given = receipts.select(*keys, facts.alias("given"))
    found = receipts_of(journal).select(*keys, facts.alias("found"))
    return given.join(found, keys, "full").select(*keys, F.col("given").eqNullSafe(F.col("found")).alias("held"))
