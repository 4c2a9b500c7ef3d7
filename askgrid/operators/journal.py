"""Hash-chained journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chained(entries: DataFrame) -> DataFrame:
    """Chain (run, position, record): each hash covers the previous hash and the record.

    A chain is sequential by definition; it is folded inside its run, whose
    number of entries is the fixed case list of that run.
    """
    runs = entries.groupBy("run").agg(F.array_sort(F.collect_list(
        F.struct("position", "record"))).alias("entries"))
    start = F.struct(
        F.sha2(F.concat(F.lit("run "), F.col("run").cast("string")), 256).alias("sha"),
        F.array().cast("array<struct<position:bigint,record:string,previous_sha:string,sha:string>>")
        .alias("done"))

    def step(state, entry):
        sha = F.sha2(F.concat(state["sha"], entry["record"]), 256)
        row = F.struct(entry["position"].alias("position"), entry["record"].alias("record"),
                       state["sha"].alias("previous_sha"), sha.alias("sha"))
        return F.struct(sha.alias("sha"), F.concat(state["done"], F.array(row)).alias("done"))

    folded = runs.select("run", F.aggregate("entries", start, step, lambda state: state["done"])
                         .alias("done"))
    return folded.select("run", F.inline("done"))


def verify_chain(journal: DataFrame) -> DataFrame:
    """Adds ``linked``: the hash is right and continues the entry before it."""
    w = Window.partitionBy("run").orderBy("position")
    first = F.sha2(F.concat(F.lit("run "), F.col("run").cast("string")), 256)
    before = F.coalesce(F.lag("sha").over(w), first)
    right = F.sha2(F.concat(F.col("previous_sha"), F.col("record")), 256)
    return journal.withColumn("linked", (F.col("previous_sha") == before) & (F.col("sha") == right))
