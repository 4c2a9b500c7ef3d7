"""The journal as a stream: restarts, repeats, replays, one writer, receipts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from askgrid.operators.journal import chained, verify_chain
from askgrid.streaming.journal_stream import (
    JournalHeld, append_available, check_receipts, claim, read_journal, read_receipts)

SCHEMA = "run long, position long, record string"
FIRST = [(1, 0, "a"), (1, 2, "c"), (1, 1, "b"), (2, 5, "x"), (None, 1, "no run"), (3, None, "no place")]
SECOND = [(1, 1, "b"), (1, 3, "d"), (1, 3, "e"), (2, 6, None), (2, 9, "ü" * 5000), (4, 0, "")]


def deliver(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def run(spark, source, path, checkpoint):
    append_available(spark.readStream.schema(SCHEMA).parquet(source), path, checkpoint)


def rows_of(journal):
    return sorted((r.run, r.position, r.record, r.previous_sha, r.sha) for r in journal.where("appended").select(
        "run", "position", "record", "previous_sha", "sha").collect())


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / name) for name in ("log", "journal", "state")]


def test_restart_continues_the_chains(spark, places):
    source, path, checkpoint = places
    deliver(spark, source, FIRST)
    run(spark, source, path, checkpoint)
    deliver(spark, source, SECOND)
    run(spark, source, path, checkpoint)
    journal = read_journal(spark, path)
    whole = chained(spark.createDataFrame(
        [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 5, "x"), (2, 6, ""), (2, 9, "ü" * 5000), (4, 0, "")],
        SCHEMA))
    assert rows_of(journal) == rows_of(whole.withColumn("appended", F.lit(True)))
    refused = sorted(((r.run, r.position, r.record) for r in journal.where("NOT appended").collect()), key=str)
    assert refused == sorted([(None, 1, "no run"), (3, None, "no place"), (1, 1, "b"), (1, 3, "e")], key=str)
    assert verify_chain(journal.where("appended")).where("NOT linked").count() == 0
    receipts = read_receipts(spark, path)
    assert receipts.count() == 5 and check_receipts(journal, receipts).where("NOT held").count() == 0

    # Nothing new: nothing is appended. A batch whose commit was lost is repeated and replaces itself.
    run(spark, source, path, checkpoint)
    before = rows_of(read_journal(spark, path))
    for name in ("1", ".1.crc"):
        Path(checkpoint, "commits", name).unlink()
    run(spark, source, path, checkpoint)
    assert rows_of(read_journal(spark, path)) == before

    # The end cut off: every link is right, the receipt is not.
    receipts = read_receipts(spark, path)
    cut = read_journal(spark, path).where("NOT (run = 2 AND position = 9)")
    assert verify_chain(cut.where("appended")).where("NOT linked").count() == 0
    assert [(r.run, r.batch_id) for r in check_receipts(cut, receipts).where("NOT held").collect()] == [(2, 1)]
    lost = read_journal(spark, path).where("batch_id = 1")
    assert {(r.run, r.batch_id) for r in check_receipts(lost, receipts).where("NOT held").collect()} == {(1, 0), (2, 0)}


def test_second_writer_is_refused(spark, places, tmp_path):
    source, path, checkpoint = places
    deliver(spark, source, FIRST)
    run(spark, source, path, checkpoint)
    before = rows_of(read_journal(spark, path))
    with pytest.raises(JournalHeld):
        run(spark, source, path, str(tmp_path / "other"))
    claim(spark, path, checkpoint)
    assert rows_of(read_journal(spark, path)) == before


def test_empty_delivery(spark, places):
    source, path, checkpoint = places
    deliver(spark, source, [])
    run(spark, source, path, checkpoint)
    deliver(spark, source, FIRST)
    run(spark, source, path, checkpoint)
    assert len(rows_of(read_journal(spark, path))) == 4
