"""Candidate union, reranking and the evidence behind a ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.functions import text as tx
from askgrid.operators.bounded import broadcast_if_small


def union_candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """(question_id, id, sources): each candidate once, with the sources that found it."""
    tagged = [frame.select("question_id", "id", F.lit(name).alias("source"))
              for name, frame in sources.items()]
    return (reduce(DataFrame.unionByName, tagged)
            .groupBy("question_id", "id")
            .agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")))


def overlap_score(question: Column, document: Column) -> Column:
    """Deterministic pair score: weighted share of the question terms in the document.

    Stands in for a cross-encoder; any column of (question terms, document
    terms) can replace it.
    """
    total = F.aggregate(question, F.lit(0.0), lambda acc, term: acc + tx.token_weight(term))
    shared = F.aggregate(F.array_intersect(question, document), F.lit(0.0),
                         lambda acc, term: acc + tx.token_weight(term))
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def score_candidates(candidates: DataFrame, questions: DataFrame, documents: DataFrame,
                     scorer=overlap_score) -> DataFrame:
    """Attach a pair score to each candidate. ``documents``: (id, tokens)."""
    asked = questions.select("question_id", F.array_distinct(
        tx.question_tokens(F.col("text"))).alias("terms"))
    return (candidates.join(documents.select("id", F.array_distinct("tokens").alias("tokens")), "id")
            .join(broadcast_if_small(asked), "question_id")
            .withColumn("pair_score", F.round(scorer(F.col("terms"), F.col("tokens")), 9))
            .drop("terms", "tokens"))


def rerank(scored: DataFrame, k: int = fixed.FINAL_DEPTH) -> DataFrame:
    """Best k per question by (score descending, id ascending); scores must be finite."""
    finite = F.when(F.isnan("pair_score") | F.col("pair_score").isNull(),
                    F.raise_error(F.lit("Pair score is not finite"))).otherwise(F.col("pair_score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("pair_score"), "id")
    return (scored.withColumn("pair_score", finite)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def pair_tokens(left: str, right: str) -> Column:
    """Words of a question and a document together."""
    return F.size(F.split(tx.collapse(F.col(left)), " ")) + F.size(F.split(tx.collapse(F.col(right)), " "))


def check_pair_budget(pairs: DataFrame, left: str, right: str,
                      budget: int = fixed.PAIR_TOKEN_BUDGET) -> DataFrame:
    """Fail when a question and document together exceed the token budget."""
    size = pair_tokens(left, right)
    return pairs.withColumn("pair_tokens", F.when(
        size > budget, F.raise_error(F.lit("Pair exceeds its token budget"))).otherwise(size))


def summary(representation: Column, limit: int = fixed.SUMMARY_LIMIT) -> Column:
    """Identity and column lines of a representation, collapsed and shortened."""
    lines = F.filter(F.transform(F.split(representation, "\n"), F.trim), lambda line: line != "")
    def first(prefix):
        return F.try_element_at(F.filter(lines, lambda line: line.startswith(prefix)), F.lit(1))
    parts = F.array_join(F.filter(F.array(first("Identity:"), first("Columns:")),
                                  lambda part: part.isNotNull()), " · ")
    chosen = F.when(parts == "", representation).otherwise(parts)
    return tx.shorten(tx.collapse(chosen), limit)
