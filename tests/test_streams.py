"""Sessions of a stream: late records, merges, restarts, what stays open."""

import datetime as dt

from askgrid.streaming.log_stream import after_sessions, sessions, write_available

SCHEMA = "at timestamp, who long, value double"


def at(minutes):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minutes)


def batch(spark, path, rows):
    spark.createDataFrame([(None if m is None else at(m), who, float(v)) for m, who, v in rows],
                          SCHEMA).coalesce(1).write.mode("append").parquet(path)


def found(frame):
    zone = [(r.who, r.session_start, r.session_end, r.records, r.largest) for r in frame.collect()]
    return sorted(zone, key=str)


def test_sessions_over_two_runs(spark, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("log", "out", "state"))

    def run():
        write_available(sessions(spark.readStream.schema(SCHEMA).parquet(source), "at", "who", "value"), out, state)

    # Exactly the gap apart is one session; null users are one user; no time, no session.
    batch(spark, source, [(0, 1, 3), (30, 1, 5), (61, 1, 1), (5, None, 2), (6, None, 1), (None, 1, 9), (100, 2, 0)])
    run()
    # The watermark stands at 90: a record of minute 85 is late, yet belongs to a session that is still open.
    batch(spark, source, [(85, 1, 7), (200, 3, 4)])
    run()
    closed = spark.read.parquet(out)
    assert found(closed) == sorted([
        (1, at(0), at(60), 2, 5.0), (1, at(61), at(115), 2, 7.0), (None, at(5), at(36), 2, 2.0),
        (2, at(100), at(130), 1, 0.0)], key=str)
    records = spark.read.schema(SCHEMA).parquet(source)
    growing = sessions(after_sessions(records, closed, "at", "who"), "at", "who", "value", delay=None)
    assert found(growing) == [(3, at(200), at(230), 1, 4.0)]
    # Together they are the sessions of one uninterrupted batch.
    whole = sessions(records, "at", "who", "value", delay=None)
    assert found(whole) == sorted(found(closed) + found(growing), key=str)


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    whole = sessions(empty, "at", "who", "value", delay=None)
    assert whole.count() == 0 and after_sessions(empty, whole, "at", "who").count() == 0
    assert whole.columns == ["who", "session_start", "session_end", "records", "largest"]
