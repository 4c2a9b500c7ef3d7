"""Metrics over rankings: (question_id, id, rank) against (question_id, id) expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that are no evidence.
EVIDENCE_STOP_WORDS = (
    "a", "an", "and", "as", "at", "be", "by", "each", "for", "from", "in",
    "including", "into", "is", "it", "of", "on", "only", "or", "show", "the",
    "their", "to", "with",
)


def recall(expected: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """Per case: expected members, members in the Top-k and their share."""
    top = ranking.where(F.col("rank") <= k).select("question_id", "id", F.lit(1).alias("hit"))
    return (expected.join(top, ["question_id", "id"], "left").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("expected_count"), F.count("hit").alias("found"))
        .withColumn("recall", F.col("found").cast("double") / F.col("expected_count")))


def macro(per_case: DataFrame, groupings: list[str]) -> DataFrame:
    """Macro recall overall and by each grouping, whose NULL group drops out."""
    labels = [F.struct(F.lit("overall").alias("grouping_name"), F.lit("overall").alias("group_value"))]
    labels += [F.struct(F.lit(name).alias("grouping_name"), F.col(name).alias("group_value"))
               for name in groupings]
    return (per_case.select("recall", "found", "expected_count", F.inline(F.array(*labels)))
            .where("group_value IS NOT NULL").groupBy("grouping_name", "group_value").agg(
        F.count(F.lit(1)).alias("question_count"), F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.count_if(F.col("found") == F.col("expected_count")).alias("full_coverage_count")))


def coverage(expected: DataFrame, rankings: dict[str, DataFrame], unions: dict[str, tuple],
             depths: tuple[int, ...]) -> DataFrame:
    """Candidate recall of systems and unions of systems at several depths."""
    joined = expected
    for name, ranking in rankings.items():
        joined = joined.join(ranking.select("question_id", "id", F.col("rank").alias(f"_{name}")),
                             ["question_id", "id"], "left")
    best = {name: F.col(f"_{name}") for name in rankings}
    best |= {name: F.least(*[F.col(f"_{part}") for part in parts]) for name, parts in unions.items()}
    cells = [(name, depth) for name in best for depth in depths]
    per_case = joined.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(best[name] <= depth).alias(f"_c{i}") for i, (name, depth) in enumerate(cells)])
    long = per_case.select("n", F.inline(F.array(*[
        F.struct(F.lit(name).alias("system"), F.lit(depth).alias("depth"), F.col(f"_c{i}").alias("found"))
        for i, (name, depth) in enumerate(cells)])))
    return long.groupBy("system", "depth").agg(
        F.count(F.lit(1)).alias("cases"),
        F.round(F.avg(F.col("found").cast("double") / F.col("n")), 6).alias("candidate_recall"),
        F.count_if(F.col("found") == F.col("n")).alias("every_expected"),
        F.count_if(F.col("found") > 0).alias("any_expected"),
        F.sum(F.col("n") - F.col("found")).alias("absent"))


def rank_class(rank: Column) -> Column:
    return (F.when(rank.isNull() | (rank > 200), "absent beyond 200")
            .when(rank <= 20, "easy candidate").when(rank <= 50, "moderate candidate")
            .when(rank <= 100, "broad candidate").otherwise("very broad candidate"))


def miss_classes(expected: DataFrame, candidates: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Candidate-generation and reranker failures, and the recall the candidates allow."""
    pool = candidates.select("question_id", "id", F.lit(True).alias("candidate"))
    top = ranked.where(F.col("rank") <= k).select("question_id", "id", F.lit(True).alias("kept"))
    joined = (expected.join(pool, ["question_id", "id"], "left")
              .join(top, ["question_id", "id"], "left"))
    counts = joined.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("expected_count"), F.count("candidate").alias("candidate_expected"),
        F.count("kept").alias("found"),
        F.count_if(F.col("candidate").isNull()).alias("candidate_generation_failures"),
        F.count_if(F.col("candidate").isNotNull() & F.col("kept").isNull())
        .alias("reranker_failures"))
    reachable = F.least(F.lit(k).cast("bigint"), F.col("candidate_expected"))
    return (counts.withColumn("capacity_limited", F.col("candidate_expected") > k)
            .withColumn("oracle_recall", F.round(
                reachable.cast("double") / F.col("expected_count"), 6))
            .withColumn("oracle_gap", F.round(
                (reachable - F.col("found")).cast("double") / F.col("expected_count"), 6)))


def transitions(expected: DataFrame, old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Per case: recall before and after, its direction, members gained and lost."""
    before = old.where(F.col("rank") <= k).select("question_id", "id", F.lit(1).alias("was"))
    after = new.where(F.col("rank") <= k).select("question_id", "id", F.lit(1).alias("now"))
    joined = (expected.join(before, ["question_id", "id"], "left")
              .join(after, ["question_id", "id"], "left"))
    counts = joined.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("was").alias("b"), F.count("now").alias("a"),
        F.count_if(F.col("now").isNotNull() & F.col("was").isNull()).alias("gained"),
        F.count_if(F.col("was").isNotNull() & F.col("now").isNull()).alias("lost"))
    direction = (F.when(F.col("a") > F.col("b"), "improved")
                 .when(F.col("a") < F.col("b"), "regressed").otherwise("unchanged"))
    return counts.select(
        "question_id", F.round(F.col("b").cast("double") / F.col("n"), 6).alias("old_recall"),
        F.round(F.col("a").cast("double") / F.col("n"), 6).alias("new_recall"),
        direction.alias("transition"), "gained", "lost")


def changed_members(expected: DataFrame, old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Expected members inside the Top-k of one ranking only: gained or lost, with both ranks."""
    def ranks(frame, name):
        return frame.select("question_id", "id", F.col("rank").alias(name))

    joined = (expected.join(ranks(old, "old_rank"), ["question_id", "id"], "left")
              .join(ranks(new, "new_rank"), ["question_id", "id"], "left"))
    was, now = (F.coalesce(F.col(name) <= k, F.lit(False)) for name in ("old_rank", "new_rank"))
    return joined.where(was != now).select(
        "question_id", "id", F.when(now, "gained").otherwise("lost").alias("status"), "old_rank", "new_rank")


def average_rank(rows: DataFrame, keys: list[str], value: str, output: str,
                 bucket: Column) -> DataFrame:
    """Ascending rank with ties averaged, from counts per distinct value.

    Values are cut into ``bucket``s that follow their order: counts before a
    bucket come from one row per bucket, counts inside it from one row per
    distinct value, so a large group is never ranked in one task.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bucket", bucket)
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in_bucket"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)))
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    ranks = (counts.join(starts.select(*keys, "_bucket", "_start"), [*keys, "_bucket"])
             .withColumn("_below", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
             .select(*keys, value, (F.col("_below") + 1 + (F.col("_n") - 1) / 2.0).alias(output)))
    return rows.join(ranks, [*keys, value])


def evidence_words(value: Column) -> Column:
    """Distinct lower-case words of more than two characters that are not stop words."""
    split = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.regexp_extract_all(split, F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0))
    kept = F.filter(words, lambda word: (F.length(word) > 2)
                    & ~F.lower(word).isin(*EVIDENCE_STOP_WORDS))
    return F.array_distinct(F.transform(kept, F.lower))


def execution_accuracy(records: DataFrame, denominators: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome counts and accuracy per run.

    The denominator is the number of cases of the run; missing or blocked
    cases block publication and leave the accuracy NULL.
    """
    def of(name):
        return F.count_if(F.col("outcome") == name)

    def stratum(condition, name):
        return [F.count_if(condition).alias(f"{name}_count"),
                F.count_if(condition & (F.col("outcome") == "EXECUTION_CORRECT"))
                .alias(f"{name}_correct")]

    counts = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("case_count"), of("EXECUTION_CORRECT").alias("correct"),
        of("RESULT_MISMATCH").alias("mismatched"), of("EXECUTION_ERROR").alias("failed"),
        of("VALIDATION_REJECTED").alias("rejected"), of("EVALUATION_BLOCKED").alias("_blocked"),
        *stratum(F.col("empty_gold"), "empty"), *stratum(~F.col("empty_gold"), "nonempty"))
    complete = (F.col("_blocked") == 0) & (F.col("case_count") == F.col("denominator"))
    return (counts.join(denominators, keys)
            .withColumn("publication_status", F.when(complete, "COMPLETE").otherwise("BLOCKED"))
            .withColumn("execution_accuracy", F.when(complete, F.round(
                F.col("correct").cast("double") / F.col("denominator"), 6)))
            .drop("_blocked", "denominator"))


def outcome(stage: Column, code: Column) -> Column:
    """Outcome of a failed case."""
    blocked_codes = ("TEMPORAL_PRECISION_NOT_LOSSLESS", "SNAPSHOT_TRANSACTION_REQUIRED")
    return (F.when(stage == "GENERATION", "GENERATION_ERROR")
            .when(code == "RESOURCE_LIMIT_INCOMPLETE_RESULT", "EVALUATION_LIMIT")
            .when(stage.isin("OUTPUT_PARSING", "VALIDATION"), "VALIDATION_REJECTED")
            .when((stage == "GOLD_EXECUTION") | code.isin(*blocked_codes), "EVALUATION_BLOCKED")
            .when(stage == "PREDICTION_EXECUTION", "EXECUTION_ERROR")
            .otherwise("GENERATION_ERROR"))
