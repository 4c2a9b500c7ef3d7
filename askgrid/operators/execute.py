"""Bounded execution of validated SQL."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from askgrid.operators.guard import bind, validate


@dataclass
class Execution:
    status: str
    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    validation_errors: list[str] = field(default_factory=list)
    execution_error: str | None = None
    execution_time: float | None = None
    complete: bool = True

    @property
    def row_count(self) -> int:
        return len(self.rows)


def run_with_timeout(spark: SparkSession, action, seconds: float):
    """Run an action; from the deadline on its jobs are interrupted by tag.

    The interrupt is repeated until the action ends, since a query may start
    further jobs after the first interrupt.
    """
    tag = f"askgrid-{uuid.uuid4().hex}"
    finished, expired = threading.Event(), threading.Event()

    def watch():
        if finished.wait(seconds):
            return
        expired.set()
        while not finished.is_set():
            spark.interruptTag(tag)
            finished.wait(0.2)

    spark.addTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        result = action()
    except Exception as exc:
        if expired.is_set():
            raise TimeoutError("Query timed out") from exc
        raise
    finally:
        finished.set()
        watcher.join()
        spark.removeTag(tag)
    if expired.is_set():
        raise TimeoutError("Query timed out")
    return result


def execute(spark: SparkSession, text: str, known_tables: list[str], values: dict | None = None,
            max_rows: int = 100, timeout: float = 10.0) -> Execution:
    """Validate again, run, and fetch at most ``max_rows`` rows.

    ``complete`` says whether these are all; a cut result is never a full one.
    """
    args = bind(text, values or {}) if values else {}
    checked = validate(spark, text, known_tables, args)
    if not checked.valid:
        return Execution("rejected", checked.cleaned_sql, validation_errors=checked.errors)
    started = time.perf_counter()
    try:
        frame = spark.sql(checked.cleaned_sql, args=args)
        rows: list[Row] = run_with_timeout(spark, frame.limit(max_rows + 1).collect, timeout)
    except TimeoutError:
        raise
    except Exception as exc:
        return Execution("execution_error", checked.cleaned_sql,
                         execution_error=type(exc).__name__,
                         execution_time=time.perf_counter() - started)
    return Execution("success", checked.cleaned_sql, list(frame.columns),
                     [list(row) for row in rows[:max_rows]],
                     execution_time=time.perf_counter() - started, complete=len(rows) <= max_rows)


def guarded_frame(spark: SparkSession, text: str, known_tables: list[str],
                  values: dict | None = None) -> DataFrame:
    """The lazy result of a validated query; raises when it is rejected."""
    args = bind(text, values or {})
    checked = validate(spark, text, known_tables, args)
    if not checked.valid:
        raise ValueError("; ".join(checked.errors) or checked.status)
    return spark.sql(checked.cleaned_sql, args=args)


def sample(frame: DataFrame, size: int) -> tuple[list[Row], bool]:
    """First rows and whether they are all: one extra row answers that without a count."""
    rows = frame.limit(size + 1).collect()
    return rows[:size], len(rows) <= size


def column_profile(frame: DataFrame) -> DataFrame:
    """(column_name, rows, nulls, blanks) in one pass over the frame."""
    kinds = dict(frame.dtypes)
    counts = frame.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(F.col(name).isNull()).alias(f"_n{i}") for i, name in enumerate(frame.columns)], *[
        (F.count_if(F.trim(F.col(name)) == "") if kinds[name] == "string" else F.lit(0).cast("bigint"))
        .alias(f"_b{i}") for i, name in enumerate(frame.columns)])
    cells = [F.struct(F.lit(name).alias("column_name"), F.col("_rows").alias("rows"),
                      F.col(f"_n{i}").alias("nulls"), F.col(f"_b{i}").alias("blanks"))
             for i, name in enumerate(frame.columns)]
    return counts.select(F.inline(F.array(*cells))).withColumn(
        "entirely_null", (F.col("nulls") == F.col("rows")) & (F.col("rows") > 0))
