"""Order-dependent operators with a bounded amount of rows per task.

A plain window over a key puts every row of a heavy key in one task. Here a
key is cut into buckets that follow the order (days or months, optionally a
range of the tie-break id). What earlier buckets contribute is computed from
one row per bucket and enters each bucket as one extra "carry" row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` values per key, combined before the shuffle."""
    values = [name for name in rows.columns if name not in keys]
    best = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], bucket: Column,
                value: str, output: str) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING)``.

    ``bucket`` must not decrease along ``order`` and ``order`` must be unique
    per key.
    """
    names = rows.columns
    bucketed = rows.withColumn("_bucket", bucket)
    totals = bucketed.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = (totals.withColumn("_amount", F.sum("_total").over(before))
             .where(F.col("_amount").isNotNull())
             .select(*keys, "_bucket", "_amount", F.lit(False).alias("_detail")))
    detail = bucketed.withColumn("_amount", F.col(value)).withColumn("_detail", F.lit(True))
    within = (Window.partitionBy(*keys, "_bucket").orderBy("_detail", *order)
              .rowsBetween(Window.unboundedPreceding, 0))
    return (detail.unionByName(carry, allowMissingColumns=True)
            .withColumn(output, F.sum("_amount").over(within))
            .where("_detail").select(*names, output))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str,
              right_time: str, right_order: list[str], values: list[str],
              bucket=F.to_date) -> DataFrame:
    """Attach to each left row the last right row at or before its time.

    ``values`` of the right row (time included if named) are added; they are
    NULL where no earlier right row exists. ``right_order`` breaks ties.
    """
    history = right.select(
        *keys, bucket(F.col(right_time)).alias("_bucket"),
        F.struct(F.col(right_time).alias("_time"),
                 *[F.col(name).alias(f"_o{i}") for i, name in enumerate(right_order)]
                 ).alias("_order"),
        F.struct(*values).alias("_value"))
    probes = left.select(*left.columns, bucket(F.col(left_time)).alias("_bucket"),
                         F.col(left_time).alias("_probe_time"))
    last = history.groupBy(*keys, "_bucket").agg(
        F.max_by(F.struct("_order", "_value"), "_order").alias("_last"))
    cells = (probes.select(*keys, "_bucket").distinct()
             .unionByName(last, allowMissingColumns=True)
             .groupBy(*keys, "_bucket").agg(F.max_by("_last", "_last._order").alias("_last")))
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = (cells.withColumn("_carried", F.last("_last", ignorenulls=True).over(before))
             .where(F.col("_carried").isNotNull())
             .select(*keys, "_bucket", F.col("_carried._order").alias("_order"),
                     F.col("_carried._value").alias("_value")))
    merged = probes.withColumn("_is_probe", F.lit(1)).unionByName(
        history.unionByName(carry).withColumn("_is_probe", F.lit(0)),
        allowMissingColumns=True)
    within = (Window.partitionBy(*keys, "_bucket")
              .orderBy(F.coalesce("_order._time", "_probe_time"), "_is_probe", "_order")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (merged.withColumn("_match", F.last("_value", ignorenulls=True).over(within))
            .where("_is_probe = 1")
            .select(*left.columns, *[F.col(f"_match.{name}").alias(name) for name in values]))


def range_join_by_month(facts: DataFrame, periods: DataFrame, at: str, start: str,
                        end: str, how: str = "inner") -> DataFrame:
    """Date-into-period join with an equality on the month.

    Each period is repeated for the months it touches, so Spark can hash or
    broadcast on the month instead of comparing every fact with every period.
    Only where the period side is small enough does Spark broadcast it, by
    its own size check.
    """
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    by_month = periods.withColumn("_month", F.explode(months))
    on = (F.trunc(facts[at], "MM") == by_month["_month"]) & facts[at].between(
        by_month[start], by_month[end])
    return facts.join(by_month, on, how).drop("_month")
