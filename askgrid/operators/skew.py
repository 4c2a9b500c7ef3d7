"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators.bounded import cut

TARGET_ROWS_PER_TASK = 2_000_000


def attach_by_key(rows: DataFrame, grouped: DataFrame, keys: list[str], count_column: str,
                  target_rows: int = TARGET_ROWS_PER_TASK) -> DataFrame:
    """Left join ``rows`` to one row per key, splitting heavy keys.

    ``grouped`` holds one row per key and the number of ``rows`` of that key.
    A key with more than ``target_rows`` rows is copied ceil(n / target_rows)
    times and its rows are spread over the copies by a hash of their content.
    The broadcast set holds only such keys: at most rows / target_rows of them.
    NULL keys match each other, as in a window partition.
    """
    values = [name for name in grouped.columns if name not in keys]
    copies = F.ceil(F.col(count_column) / F.lit(target_rows)).cast("int")
    heavy = (grouped.where(F.col(count_column) > target_rows)
             .select(*[F.col(key).alias(f"_h_{key}") for key in keys],
                     copies.alias("_copies")))
    on_heavy = reduce(lambda a, b: a & b,
                      [F.col(key).eqNullSafe(F.col(f"_h_{key}")) for key in keys])
    spread = F.pmod(F.xxhash64(*[F.col(name) for name in rows.columns]),
                    F.coalesce("_copies", F.lit(1))).cast("int")
    salted = (rows.join(F.broadcast(heavy), on_heavy, "left")
              .withColumn("_salt", spread)
              .drop("_copies", *[f"_h_{key}" for key in keys]))
    replicated = (grouped
                  .withColumn("_g_salt", F.explode(F.sequence(
                      F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
                  .select("_g_salt", *[F.col(key).alias(f"_g_{key}") for key in keys], *values))
    on = reduce(lambda a, b: a & b,
                [F.col(key).eqNullSafe(F.col(f"_g_{key}")) for key in keys],
                F.col("_salt") == F.col("_g_salt"))
    return (salted.join(replicated, on, "left")
            .drop("_salt", "_g_salt", *[f"_g_{key}" for key in keys]))


def group_values_over(rows: DataFrame, keys: list[str], aggregates: dict,
                      target_rows: int = TARGET_ROWS_PER_TASK) -> DataFrame:
    """``agg(x) OVER (PARTITION BY keys)`` without a window.

    The aggregate is combined before the shuffle, and heavy keys are split
    when the totals are attached to the detail rows. The totals are cut, since
    finding the heavy keys and attaching the totals both read them.
    """
    grouped = cut(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_group_rows"),
        *[column.alias(name) for name, column in aggregates.items()]))
    return attach_by_key(rows, grouped, keys, "_group_rows", target_rows).drop("_group_rows")
