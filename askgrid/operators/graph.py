"""One-hop relationship expansion of ranked seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.operators.bounded import (
    MAX_BROADCAST_ROWS, broadcast_if_small, fits, small_side)

SIGNAL_DIGITS = 9
SCORE_DIGITS = 12


def adjacency(links: DataFrame, indexed: DataFrame) -> DataFrame:
    """Distinct (src, dst) between indexed members, without self edges."""
    members = indexed.select(F.col("id").alias("dst"))
    sources = indexed.select(F.col("id").alias("src"))
    return (links.where("src <> dst").select("src", "dst").distinct()
            .join(members, "dst", "left_semi").join(sources, "src", "left_semi")
            .select("src", "dst"))


def touching(links: DataFrame, seeds: DataFrame, end: str) -> DataFrame:
    """Links whose ``end`` is a seed: one hop needs no other, so the rest is never shuffled."""
    ids = seeds.select(F.col("id").alias(end)).distinct()
    return links.join(small_side(ids, fits(seeds, MAX_BROADCAST_ROWS)), end, "left_semi").select(
        "src", "dst")


def seed_edges(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges leaving the seeds: (question_id, id, source, seed_rank, signal)."""
    signal = F.round(F.col("score") / F.log2(F.col("rank") + F.lit(1)), SIGNAL_DIGITS)
    probes = seeds.select("question_id", F.col("id").alias("src"), F.col("rank").alias("seed_rank"),
                          signal.alias("signal"))
    return edges.join(broadcast_if_small(probes), "src").select(
        "question_id", F.col("dst").alias("id"), F.col("src").alias("source"), "seed_rank", "signal")


def best_signals(reached: DataFrame) -> DataFrame:
    """Best signal per reached row: highest signal, then lowest seed rank, then lowest source."""
    return reached.groupBy("question_id", "id").agg(
        F.max("signal").alias("graph_signal"),
        F.min(F.struct(-F.col("signal"), "seed_rank", "source")).alias("best"),
        F.count(F.lit(1)).alias("source_count")).select(
        "question_id", "id", "graph_signal", F.col("best.seed_rank").alias("best_rank"),
        F.col("best.source").alias("best_source"), "source_count")


def expand(seeds: DataFrame, edges: DataFrame, score_pairs, k: int) -> DataFrame:
    """Seeds and their direct neighbours, ranked with the relationship bonus.

    ``score_pairs`` returns (question_id, id, dense, lexical, score) for pairs;
    only seeds and reached rows are scored, never the whole grid.
    """
    return rank_reached(seeds, seed_edges(seeds, edges), score_pairs, k)


def rank_reached(seeds: DataFrame, reached: DataFrame, score_pairs, k: int) -> DataFrame:
    signals = best_signals(reached)
    own = seeds.select("question_id", "id", F.lit(True).alias("is_seed"))
    candidates = (signals.join(own, ["question_id", "id"], "full")
                  .withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
                  .withColumn("graph_signal", F.coalesce("graph_signal", F.lit(0.0)))
                  .withColumn("source_count", F.coalesce("source_count", F.lit(0))))
    scored = score_pairs(candidates.select("question_id", "id"))
    final = (candidates.join(scored, ["question_id", "id"])
             .withColumn("bonus", F.round(fixed.FK_BONUS * F.col("graph_signal"), SCORE_DIGITS))
             .withColumn("final_score", F.round(F.col("score") + F.col("bonus"), SCORE_DIGITS)))
    w = Window.partitionBy("question_id").orderBy(
        F.desc("final_score"), F.desc("score"), F.desc("id"))
    return final.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def additional_edges(seeds: DataFrame, extra: DataFrame, score_pairs,
                     cap: int = fixed.ADDITIONAL_NEIGHBOR_CAP) -> DataFrame:
    """Best ``cap`` additional neighbours per seed by (score, id) descending.

    The cap is part of the ranking rule. Adds the number considered per seed.
    """
    reached = seed_edges(seeds, extra)
    scored = reached.join(
        score_pairs(reached.select("question_id", "id").distinct()).select(
            "question_id", "id", "score"), ["question_id", "id"])
    considered = scored.groupBy("question_id", "source").agg(
        F.count(F.lit(1)).alias("considered"))
    w = Window.partitionBy("question_id", "source").orderBy(F.desc("score"), F.desc("id"))
    admitted = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    bounded = fits(seeds, MAX_BROADCAST_ROWS)
    return admitted.join(small_side(considered, bounded), ["question_id", "source"]).drop("n")
