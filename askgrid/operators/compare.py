"""Comparison of result sets as unordered multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _positional(frame: DataFrame, side: int) -> DataFrame:
    kinds = dict(frame.dtypes)
    columns = []
    for i, name in enumerate(frame.columns):
        value = F.col(f"`{name}`")
        if kinds[name] in ("double", "float"):
            value = F.when(F.isnan(value) | (F.abs(value) == float("inf")),
                           F.raise_error(F.lit("NONFINITE_FLOAT"))).otherwise(value)
        columns.append(value.alias(f"c{i}"))
    return frame.select(*columns, F.lit(side).alias("_side"))


def differences(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows whose number of copies differs: values by position, surplus > 0 on the gold side.

    NULL equals NULL, duplicates count, column names do not. One aggregation
    over both sides, with copies combined before the shuffle.
    """
    if len(gold.columns) != len(predicted.columns):
        raise ValueError("RESULT_WIDTH_MISMATCH")
    both = _positional(gold, 1).union(_positional(predicted, -1))
    keys = [f"c{i}" for i in range(len(gold.columns))]
    return both.groupBy(*keys).agg(F.sum("_side").alias("surplus")).where("surplus <> 0")


def verdict(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: rows of both sides, differing rows, and the comparison status."""
    if len(gold.columns) != len(predicted.columns):
        raise ValueError("RESULT_WIDTH_MISMATCH")
    both = _positional(gold, 1).union(_positional(predicted, -1))
    keys = [f"c{i}" for i in range(len(gold.columns))]
    grouped = both.groupBy(*keys).agg(
        F.sum("_side").alias("surplus"), F.count_if(F.col("_side") > 0).alias("g"),
        F.count_if(F.col("_side") < 0).alias("p"))
    totals = grouped.agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("gold_rows"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("predicted_rows"),
        F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).alias("differing_rows"))
    status = (F.when(F.col("differing_rows") > 0, "RESULT_MISMATCH")
              .when(F.col("gold_rows") == 0, "BOTH_EMPTY").otherwise("EXECUTION_CORRECT"))
    return totals.withColumn("status", status)
