"""The append-only log as a stream.

The log is an append-only folder, so a file source with a checkpoint reads
each record once, also after a restart. Windows are closed by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.sources.query_log import LOG_SCHEMA


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).json(path)


def hourly_counts(records: DataFrame, time: str, key: str, value: str,
                  delay: str = "10 minutes") -> DataFrame:
    """Records, and the largest value, per hour and key; late records within the delay count."""
    return (records.withWatermark(time, delay)
            .groupBy(F.window(time, "1 hour").alias("hour"), key)
            .agg(F.count(F.lit(1)).alias("records"), F.max(value).alias("largest"))
            .select(F.col("hour.start").alias("hour_start"), key, "records", "largest"))


def sessions(records: DataFrame, time: str, user: str, value: str, gap: str = "30 minutes",
             delay: str | None = "10 minutes") -> DataFrame:
    """Sessions per user: records at most ``gap`` apart, with their number and largest value.

    With a ``delay`` a stream gives the sessions its watermark has closed, and
    records within the delay still join or merge sessions. Null users are one
    user, records without a time belong to no session. ``session_end`` is the
    last record's time plus the gap.
    """
    timed = records if delay is None else records.withWatermark(time, delay)
    return (timed.groupBy(F.session_window(time, gap).alias("session"), user)
            .agg(F.count(F.lit(1)).alias("records"), F.max(value).alias("largest"))
            .select(user, F.col("session.start").alias("session_start"),
                    F.col("session.end").alias("session_end"), "records", "largest"))


def after_sessions(records: DataFrame, closed: DataFrame, time: str, user: str) -> DataFrame:
    """Records after the last closed session of their user: those of sessions that may still grow.

    Sessions of a user do not overlap, so one time per user tells.
    """
    last = closed.groupBy(F.col(user).alias("_closed_user")).agg(F.max("session_end").alias("_closed_end"))
    return (records.join(last, F.col(user).eqNullSafe(F.col("_closed_user")), "left")
            .where(F.col("_closed_end").isNull() | (F.col(time) > F.col("_closed_end")))
            .drop("_closed_user", "_closed_end"))


def write_available(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append closed windows to ``path`` and stop."""
    stream = (frame.writeStream.format("parquet").outputMode("append").option("path", path)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    stream.awaitTermination()


def unscored(pairs: DataFrame, journal: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs the journal does not hold yet: what a resumed run still has to score."""
    return pairs.join(journal.select(*keys), keys, "left_anti")
