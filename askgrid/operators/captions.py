"""Captions of tables, forms and modules in two languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import collapse


def classified(captions: DataFrame, pattern: str, matching: str, other: str) -> DataFrame:
    """Whitespace-normalised captions, blank ones dropped, with a language by script."""
    return (captions.withColumn("caption", collapse(F.col("caption"))).where("caption <> ''")
            .withColumn("language", F.when(F.col("caption").rlike(pattern), matching).otherwise(other)))


def deduplicated(captions: DataFrame, keys: list[str], provenance: str) -> DataFrame:
    """One row per caption; provenance is deduplicated before it is counted."""
    return captions.select(*keys, provenance).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("provenance_count"), F.min(provenance).alias(f"first_{provenance}"))


def ambiguity(captions: DataFrame) -> DataFrame:
    per_group = (captions.select("table_id", "level", "language", "caption").distinct()
                 .groupBy("table_id", "level", "language").agg(F.count(F.lit(1)).alias("n")))
    return per_group.groupBy("level", "language").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("ambiguous"),
        F.max("n").alias("most"))


def bilingual_pairs(captions: DataFrame, identity: list[str], first: str, second: str) -> DataFrame:
    """Captions of two languages that share a complete identity; nothing else pairs them."""
    complete = captions.dropna(subset=identity)
    left = complete.where(F.col("language") == first).select(
        *identity, F.col("caption").alias(first)).distinct()
    right = complete.where(F.col("language") == second).select(
        *identity, F.col("caption").alias(second)).distinct()
    return left.join(right, identity)


def queue(captions: DataFrame, pairs: DataFrame, language: str) -> DataFrame:
    """Captions without a partner, grouped with what they affect.

    Table counts come from deduplicated (caption, table) rows, so a caption
    used everywhere is counted over many tasks.
    """
    unpaired = captions.where(F.col("language") == language).join(
        pairs.select(F.col(language).alias("caption")), "caption", "left_anti")
    per_table = unpaired.groupBy("caption", "table_id").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("level").alias("levels"))
    return per_table.groupBy("caption").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("affected_tables"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("levels")))), ",")
        .alias("levels"), F.min(F.array_min("levels")).alias("priority_level"))
