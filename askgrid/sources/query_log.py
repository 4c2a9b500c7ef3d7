"""Append-only query log in JSON lines."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG_SCHEMA = (
    "request_id string, timestamp_utc timestamp, question string, retrieved_tables array<string>, "
    "retrieval_scores array<double>, generated_sql string, validation_status string, "
    "validation_errors array<string>, execution_status string, row_count bigint, "
    "retrieval_time_seconds double, generation_time_seconds double, execution_time_seconds double, "
    "total_time_seconds double")

LOG_FIELDS = [item.split()[0] for item in LOG_SCHEMA.split(", ")]


def log_record(**values) -> dict:
    """One record with an id and a UTC time; unknown fields are refused."""
    unknown = set(values) - set(LOG_FIELDS)
    if unknown:
        raise ValueError(f"Unknown log fields: {sorted(unknown)}")
    record = dict.fromkeys(LOG_FIELDS)
    record.update(request_id=str(uuid.uuid4()), retrieved_tables=[], retrieval_scores=[],
                  validation_errors=[],
                  timestamp_utc=datetime.datetime.now(datetime.timezone.utc))
    record.update(values)
    return record


def append(spark: SparkSession, records: list[dict], path: str) -> None:
    rows = [tuple(record[name] for name in LOG_FIELDS) for record in records]
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)
