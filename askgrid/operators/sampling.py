"""Deterministic stratified sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.operators.ordered import running_sum


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """Label of the first rule that holds."""
    chosen = F.lit(default)
    for label, condition in reversed(rules):
        chosen = F.when(condition, F.lit(label)).otherwise(chosen)
    return chosen


def allocate(counts: DataFrame, stratum: str, target: int) -> DataFrame:
    """Largest-remainder allocation with at least one per non-empty stratum.

    ``counts``: (stratum, n). There are at most ``target`` strata, which is
    checked, so the ranking over all strata is small.
    """
    filled = counts.where("n > 0")
    totals = filled.agg(F.count(F.lit(1)).alias("strata"), F.sum("n").alias("total"))
    strata, total = totals.select("strata").scalar(), totals.select("total").scalar()
    checked = F.when(strata > target, F.raise_error(
        F.lit("Target is smaller than the number of strata"))).otherwise(F.lit(target) - strata)
    quota = (filled.withColumn("remaining", checked)
             .withColumn("quota", F.col("remaining") * F.col("n") / total)
             .withColumn("whole", F.floor("quota")))
    left = F.col("remaining") - F.sum("whole").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.col("quota") - F.col("whole")), stratum)
    return quota.withColumn("place", F.row_number().over(order)).select(
        stratum, "n", (F.lit(1) + F.col("whole")
                       + F.when(F.col("place") <= left, 1).otherwise(0)).cast("bigint")
        .alias("allocated"))


def hash_positions(rows: DataFrame, stratum: str, salt: str) -> DataFrame:
    """Position of each id in its stratum by the SHA-256 of the salted id.

    Positions are numbered inside short hash ranges, so a stratum with most of
    the rows is still spread over many tasks.
    """
    hashed = rows.withColumn("order_sha256", F.sha2(
        F.concat(F.lit(salt), F.col("id").cast("string")), 256)).withColumn("_one", F.lit(1))
    return running_sum(hashed, [stratum], ["order_sha256", "id"],
                       F.substring("order_sha256", 1, 4), "_one", "position").drop("_one")
