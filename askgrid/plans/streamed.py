"""The log stream over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from askgrid.operators.journal import verify_chain
from askgrid.plans.registry import query
from askgrid.session import ensure_checkpoint_dir
from askgrid.streaming.journal_stream import append_available, check_receipts, read_journal, read_receipts
from askgrid.streaming.log_stream import after_sessions, hourly_counts, sessions, write_available


DELAY_MINUTES = 10
GAP = "30 minutes"


def _closed(t, windows):
    """What the watermark has closed of windows over the log, read once as a stream."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/log-stream-{uuid.uuid4().hex}"
    # A glob serves both a single parquet file and a folder of part files.
    source = (t.spark.readStream.schema(t.events.schema).parquet(f"{t.directory}/event[s].parquet")
              .withColumn("at", F.col("ts").cast("timestamp")))
    write_available(windows(source), f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").withColumn("is_open", F.lit(False))


@query("log_stream_rollup", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start, event_type,
       count(*) AS records, max(value) AS largest,
       date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS is_open
FROM events GROUP BY ALL""")
def log_stream_rollup(t):
    """Hourly counts of an append-only log read as a stream.

    The stream gives the windows its watermark has closed; the windows after
    it, which later records may still change, are rolled up once and marked.
    """
    closed = _closed(t, lambda source: hourly_counts(source, "at", "event_type", "value", f"{DELAY_MINUTES} minutes"))
    records = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    watermark = records.agg(F.max("at") - F.make_dt_interval(mins=F.lit(DELAY_MINUTES)))
    end = F.date_trunc("hour", F.col("at")) + F.make_dt_interval(hours=F.lit(1))
    later = hourly_counts(records.where(end > watermark.scalar()), "at", "event_type", "value")
    return closed.unionByName(later.withColumn("is_open", F.lit(True))).select(
        F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "event_type",
        "records", "largest", "is_open")


@query("log_stream_sessions", """
WITH marked AS (
  SELECT user_id, ts, value, lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE AS starts
  FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       count(*) AS records, max(value) AS largest,
       max(ts) + INTERVAL 30 MINUTE
         > (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE AS is_open
FROM numbered GROUP BY user_id, island""")
def log_stream_sessions(t):
    """Sessions of every user in the log, read as a stream.

    A session ends thirty minutes after its last record. The stream gives the
    sessions its watermark has closed; records after a user's last closed
    session form those that later records may still extend, and are marked.
    """
    closed = _closed(t, lambda source: sessions(source, "at", "user_id", "value", GAP, f"{DELAY_MINUTES} minutes"))
    records = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    growing = sessions(after_sessions(records, closed, "at", "user_id"), "at", "user_id", "value", GAP, None)
    return closed.unionByName(growing.withColumn("is_open", F.lit(True))).select(
        "user_id", *[F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
                     for name in ("session_start", "session_end")], "records", "largest", "is_open")


@query("journal_resumed", """
WITH RECURSIVE e AS (
  SELECT event_id // 50 AS run, event_id % 50 AS position, event_type || ':' || CAST(user_id AS VARCHAR) AS record,
         CASE WHEN event_id % 50 < 20 + (event_id // 50) % 7 THEN 0 ELSE 1 END AS batch_id
  FROM events),
chain AS (
  SELECT run, position, record, batch_id, sha256('run ' || run) AS previous_sha,
         sha256(sha256('run ' || run) || record) AS sha FROM e WHERE position = 0
  UNION ALL
  SELECT e.run, e.position, e.record, e.batch_id, c.sha, sha256(c.sha || e.record)
  FROM chain c JOIN e ON e.run = c.run AND e.position = c.position + 1),
sized AS (SELECT *, max(position) OVER (PARTITION BY run) AS last_position,
                 count(*) FILTER (position < 2) OVER (PARTITION BY run) AS refused FROM chain)
SELECT run, position, CAST(batch_id AS BIGINT) AS batch_id, previous_sha, sha, refused,
       NOT (run % 7 = 0 AND position = 3) AS linked,
       NOT (run % 5 = 0 AND batch_id = CASE WHEN last_position < 20 + run % 7 THEN 0 ELSE 1 END) AS held
FROM sized WHERE NOT (run % 5 = 0 AND position = last_position)""")
def journal_resumed(t):
    """A journal of the events that a stream appended to, was restarted, and continued.

    The second delivery brings the first two entries of every run again; they
    are refused. Afterwards every seventh run is forged at its fourth entry,
    which breaks a link, and every fifth loses its last entry, which only the
    receipt of its batch shows.
    """
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/journal-{uuid.uuid4().hex}"
    entries = t.events.select(
        F.floor(F.col("event_id") / 50).alias("run"), (F.col("event_id") % 50).alias("position"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("record"))
    early = F.col("position") < 20 + F.col("run") % 7
    for delivery in (entries.where(early), entries.where(~early | (F.col("position") < 2))):
        delivery.write.mode("append").parquet(f"{folder}/log")
        source = t.spark.readStream.schema(entries.schema).parquet(f"{folder}/log")
        append_available(source, f"{folder}/journal", f"{folder}/checkpoint")
    journal = read_journal(t.spark, f"{folder}/journal")
    runs = journal.groupBy("run").agg(F.max(F.when(F.col("appended"), F.col("position"))).alias("last_position"),
                                      F.count_if(~F.col("appended")).alias("refused"))
    forged = F.when((F.col("run") % 7 == 0) & (F.col("position") == 3), F.concat("record", F.lit("!")))
    tampered = (journal.where("appended").join(runs, "run")
                .where("NOT (run % 5 = 0 AND position = last_position)")
                .withColumn("record", F.coalesce(forged, "record")))
    held = check_receipts(tampered, read_receipts(t.spark, f"{folder}/journal"))
    return verify_chain(tampered).join(held, ["run", "batch_id"]).select(
        "run", "position", "batch_id", "previous_sha", "sha", "refused", "linked", "held")
