"""Exact quantiles without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _value_positions(rows: DataFrame, keys: list[str], value: str, bucket: Column) -> DataFrame:
    """One row per distinct value: count, values before it, group size.

    ``bucket`` follows the order of the value. Positions start from one row
    per bucket and continue inside the bucket over distinct values.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bucket", bucket)
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in_bucket"))
    ordered = Window.partitionBy(*keys).orderBy("_bucket")
    starts = totals.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_in_bucket").over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_start"),
        F.sum("_in_bucket").over(Window.partitionBy(*keys)).alias("_size"))
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (counts.join(starts, [*keys, "_bucket"])
            .withColumn("_below", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))))


def _value_at(position: Column, value: str) -> Column:
    return F.max(F.when((F.col("_below") < position) & (position <= F.col("_below") + F.col("_n")),
                        F.col(value)))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, bucket: Column,
                 fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at position ceil(fraction * n)."""
    placed = _value_positions(rows, keys, value, bucket)
    return placed.groupBy(*keys).agg(*[
        _value_at(F.greatest(F.lit(1), F.ceil(F.col("_size") * F.lit(fraction))), value).alias(name)
        for name, fraction in fractions.items()])


def median(rows: DataFrame, keys: list[str], value: str, bucket: Column) -> DataFrame:
    """Median, averaging the two middle values of an even group."""
    placed = _value_positions(rows, keys, value, bucket)
    low = _value_at(F.floor((F.col("_size") + 1) / 2), value)
    high = _value_at(F.floor(F.col("_size") / 2) + 1, value)
    return placed.groupBy(*keys).agg(((low + high) / 2.0).alias("median"))
