"""Exact inner-product retrieval, alone or fused with lexical scores.

Every corpus row is scored against every question, as an exact flat index
does. The question matrix is small and checked: it is held by each task, the
corpus streams past it in Arrow batches, and a batch hands on only its own
best k rows per question. Question sets above the limit are processed in
blocks, one pass per block.

Question layout: (question_id, vector). Corpus layout: (id, vector).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.operators.bounded import broadcast_if_small, cut
from askgrid.operators.lexical import best_rows, gathered, listed

MAX_QUESTIONS_IN_TASK = 4096
# The cosine is rounded once; later sums keep enough digits to stay exact.
COSINE_DIGITS = 9
SCORE_DIGITS = 12

RESULT_SCHEMA = ("question_id bigint, id bigint, part_id bigint, cosine double, dense double, "
                 "lexical double, score double")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda total, part: total + part)


def normalized_dense(cosine: Column) -> Column:
    """``clip((cos + 1) / 2, 0, 1)``."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine + 1.0) / 2.0))


def fused(dense: Column, lexical: Column) -> Column:
    return F.round(fixed.DENSE_WEIGHT * dense + fixed.LEXICAL_WEIGHT * lexical, SCORE_DIGITS)


def _question_blocks(questions: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Question ids and matrices, each of a checked size."""
    blocks = []
    rows = questions.select("question_id", "vector").limit(MAX_QUESTIONS_IN_TASK + 1).collect()
    if len(rows) <= MAX_QUESTIONS_IN_TASK:
        collected = [rows]
    else:
        parts = math.ceil(2 * questions.count() / MAX_QUESTIONS_IN_TASK)
        collected = (questions.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == part)
                     .select("question_id", "vector").collect() for part in range(parts))
    for rows in collected:
        if rows:
            blocks.append((np.array([row[0] for row in rows], dtype=np.int64),
                           np.array([row[1] for row in rows], dtype=np.float64)))
    return blocks


def _batch_scorer(spark, ids: np.ndarray, matrix: np.ndarray, k: int, mode: str):
    shared = spark.sparkContext.broadcast((ids, matrix))

    def score(batches):
        question_ids, vectors = shared.value
        by_id = np.argsort(question_ids, kind="stable")
        for batch in batches:
            if batch.empty:
                continue
            corpus = np.array(batch["vector"].tolist(), dtype=np.float64)
            cosine = np.round(corpus @ vectors.T, COSINE_DIGITS)
            dense = np.round(np.clip((cosine + 1.0) / 2.0, 0.0, 1.0), SCORE_DIGITS)
            lexical = np.zeros_like(dense)
            if mode in ("fused", "pooled fused"):
                given = [(row, asked, scores) for row, (asked, scores) in enumerate(
                    zip(batch["asked"], batch["scores"])) if asked is not None and len(asked)]
                if given:
                    rows = np.repeat([row for row, _, _ in given], [len(asked) for _, asked, _ in given])
                    asked = np.concatenate([asked for _, asked, _ in given])
                    place = np.searchsorted(question_ids[by_id], asked, side="right") - 1
                    known = (place >= 0) & (question_ids[by_id[place]] == asked)
                    lexical[rows[known], by_id[place[known]]] = np.concatenate(
                        [scores for _, _, scores in given])[known]
                total = np.round(fixed.DENSE_WEIGHT * dense + fixed.LEXICAL_WEIGHT * lexical,
                                 SCORE_DIGITS)
            else:
                total = cosine
            row_ids = batch["id"].to_numpy(dtype=np.int64)
            part_ids = batch["part_id"].to_numpy(dtype=np.int64)
            kept = []
            least = None
            if mode in ("dense", "fused") and k < len(batch):
                finite = np.nan_to_num(total, nan=-np.inf)
                least = np.partition(finite, len(batch) - k, axis=0)[len(batch) - k]
            for column, question in enumerate(question_ids):
                near = np.arange(len(batch)) if least is None else np.flatnonzero(finite[:, column] >= least[column])
                order = near[np.lexsort((part_ids[near], -row_ids[near], -dense[near, column], -total[near, column]))]
                chosen = order
                if mode in ("pooled", "pooled fused"):
                    _, first = np.unique(row_ids[order], return_index=True)
                    chosen = order[np.sort(first)]
                chosen = chosen[:k]
                kept.append(pd.DataFrame({
                    "question_id": question, "id": row_ids[chosen], "part_id": part_ids[chosen],
                    "cosine": cosine[chosen, column], "dense": dense[chosen, column],
                    "lexical": lexical[chosen, column], "score": total[chosen, column]}))
            yield pd.concat(kept, ignore_index=True)

    return score


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """Final rank by (score, dense, id) descending; partial ranks are cut before the shuffle."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("dense"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _score(questions: DataFrame, corpus: DataFrame, k: int, mode: str) -> DataFrame:
    spark = corpus.sparkSession
    parts = [corpus.mapInPandas(_batch_scorer(spark, ids, matrix, k, mode), RESULT_SCHEMA)
             for ids, matrix in _question_blocks(questions)]
    if not parts:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def dense_top(questions: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Best k rows per question by raw inner product."""
    rows = corpus.select("id", F.col("id").alias("part_id"), "vector")
    return _ranked(_score(questions, rows, k, "dense"), k)


def _best_parts(scored: DataFrame, k: int) -> DataFrame:
    """Each parent with its best chunk, the lowest chunk on equal scores; then the Top-k."""
    best = scored.groupBy("question_id", "id").agg(
        F.max_by(F.struct("part_id", "cosine", "dense", "lexical", "score"),
                 F.struct("score", -F.col("part_id"))).alias("b"))
    return _ranked(best.select("question_id", "id", "b.*"), k)


def pooled_top(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Best k parents per question, a parent scoring as its best chunk.

    ``chunks``: (id of the parent, part_id of the chunk, vector). ``part_id``
    of the result is the winning chunk.
    """
    return _best_parts(_score(questions, chunks.select("id", "part_id", "vector"), k, "pooled"), k)


def _by_document(lexical: DataFrame) -> DataFrame:
    """(id, asked, scores) of lexical scores, which are such rows or pairs (question_id, id, lexical)."""
    return lexical.select("id", "asked", "scores") if "asked" in lexical.columns else gathered(lexical)


def _with_lexical(rows: DataFrame, lexical: DataFrame) -> DataFrame:
    per_document = _by_document(lexical)
    if "asked" in lexical.columns:
        per_document = per_document.groupBy("id").agg(
            F.flatten(F.collect_list("asked")).alias("asked"), F.flatten(F.collect_list("scores")).alias("scores"))
    return rows.join(per_document, "id", "left").select("id", "part_id", "vector", "asked", "scores")


def _lexical_only(questions: DataFrame, corpus: DataFrame, lexical: DataFrame, k: int,
                  distinct: bool = False) -> DataFrame:
    """Scored rows of documents that have no vector, the best k per question of each batch."""
    none = F.lit(0.0)
    rows = _by_document(lexical).join(corpus.select("id").distinct(), "id", "left_anti")
    return (best_rows(rows, k, distinct)
            .join(broadcast_if_small(questions.select("question_id")), "question_id", "left_semi")
            .select("question_id", "id", F.col("id").alias("part_id"), none.alias("cosine"),
                    none.alias("dense"), "lexical", fused(none, F.col("lexical")).alias("score")))


def pooled_hybrid_top(questions: DataFrame, chunks: DataFrame, lexical: DataFrame,
                      k: int) -> DataFrame:
    """Best k parents by weighted best-chunk and lexical score."""
    scored = _score(questions, _with_lexical(chunks, lexical), k, "pooled fused")
    return _best_parts(scored.unionByName(_lexical_only(questions, chunks, lexical, k, True)), k)


def score_pooled_pairs(pairs: DataFrame, questions: DataFrame, chunks: DataFrame,
                       lexical: DataFrame) -> DataFrame:
    """(question_id, id, dense, lexical, score) of given (question, parent) pairs."""
    return score_pairs(pairs, questions, chunks, lexical).groupBy("question_id", "id").agg(
        F.max("dense").alias("dense"), F.max("lexical").alias("lexical"), F.max("score").alias("score"))


def hybrid_top(questions: DataFrame, corpus: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Best k rows per question by weighted dense and lexical score.

    Lexical scores are sparse rows (id, asked, scores), or pairs that are gathered
    to such rows, so the full question by document grid never leaves a batch. A
    document without a vector counts with dense 0.
    """
    rows = _with_lexical(corpus.withColumn("part_id", F.col("id")), lexical)
    scored = _score(questions, rows, k, "fused")
    return _ranked(scored.unionByName(_lexical_only(questions, corpus, lexical, k)), k)


def score_pairs(pairs: DataFrame, questions: DataFrame, corpus: DataFrame,
                lexical: DataFrame | None) -> DataFrame:
    """(question_id, id, dense, lexical, score) for given pairs only."""
    cosine = F.round(dot(F.col("vector"), F.col("question_vector")), COSINE_DIGITS)
    with_vectors = (pairs.join(corpus.select("id", "vector"), "id")
                    .join(broadcast_if_small(questions.select(
                        "question_id", F.col("vector").alias("question_vector"))), "question_id")
                    .select("question_id", "id", cosine.alias("cosine"), F.round(
                        normalized_dense(cosine), SCORE_DIGITS).alias("dense")))
    if lexical is None:
        return with_vectors.select("question_id", "id", "cosine", "dense", F.lit(0.0).alias("lexical"),
                                   F.col("dense").alias("score"))
    if "asked" in lexical.columns:
        lexical = listed(lexical.select("id", "asked", "scores").join(pairs.select("id").distinct(), "id", "left_semi"))
    return (with_vectors.drop("cosine").join(lexical.select("question_id", "id", "lexical"),
                              ["question_id", "id"], "left")
            .withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
            .withColumn("score", fused(F.col("dense"), F.col("lexical"))))


def score_all(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(question_id, id, cosine) of the whole grid, for distribution diagnostics."""
    spark = corpus.sparkSession

    def scorer(ids, matrix):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def score(batches):
            question_ids, vectors = shared.value
            for batch in batches:
                if batch.empty:
                    continue
                cosine = np.round(np.array(batch["vector"].tolist(), dtype=np.float64) @ vectors.T,
                                  COSINE_DIGITS)
                yield pd.DataFrame({
                    "question_id": np.tile(question_ids, len(batch)),
                    "id": np.repeat(batch["id"].to_numpy(dtype=np.int64), len(question_ids)),
                    "cosine": cosine.ravel()})

        return score

    rows = corpus.select("id", "vector")
    parts = [rows.mapInPandas(scorer(ids, matrix), "question_id bigint, id bigint, cosine double")
             for ids, matrix in _question_blocks(questions)]
    return reduce(DataFrame.unionByName, parts)


CELLS_PER_UNIT = 1000


def score_cells(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(cell, n, total, squares, least, most) of all cosines; the grid itself never leaves a batch.

    A cell is one thousandth; a batch gives at most one row per cell.
    """
    def scorer(shared):
        def score(batches):
            for batch in batches:
                if batch.empty:
                    continue
                cosine = np.round(np.array(batch["vector"].tolist(), dtype=np.float64) @ shared.value.T,
                                  COSINE_DIGITS).ravel()
                frame = pd.DataFrame({"cell": np.floor(cosine * CELLS_PER_UNIT).astype(np.int32),
                                      "v": cosine, "s": cosine ** 2})
                yield frame.groupby("cell").agg(
                    n=("v", "size"), total=("v", "sum"), squares=("s", "sum"), least=("v", "min"),
                    most=("v", "max")).reset_index()

        return score

    return _per_block(questions, corpus.select("vector"), scorer,
                      "cell int, n bigint, total double, squares double, least double, most double")


def values_in_cells(questions: DataFrame, corpus: DataFrame, cells: list[int]) -> DataFrame:
    """(value, n) of the cosines in a few cells, counted per batch."""
    def scorer(shared):
        def score(batches):
            for batch in batches:
                if batch.empty:
                    continue
                cosine = np.round(np.array(batch["vector"].tolist(), dtype=np.float64) @ shared.value.T,
                                  COSINE_DIGITS).ravel()
                inside = np.isin(np.floor(cosine * CELLS_PER_UNIT).astype(np.int64), cells)
                values, counts = np.unique(cosine[inside], return_counts=True)
                yield pd.DataFrame({"value": values, "n": counts})

        return score

    return _per_block(questions, corpus.select("vector"), scorer, "value double, n bigint")


def _per_block(questions: DataFrame, rows: DataFrame, scorer, schema: str) -> DataFrame:
    spark = rows.sparkSession
    parts = [rows.mapInPandas(scorer(spark.sparkContext.broadcast(matrix)), schema)
             for _, matrix in _question_blocks(questions)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def distribution(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row (n, mean, deviation, minimum, maximum, median) over all cosines, in two passes.

    The first pass counts cells, at most 2,001 of them after combining; the
    second one reads only the values of the cells that hold the median.
    """
    cells = cut(score_cells(questions, corpus).groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.min("least").alias("least"), F.max("most").alias("most")))
    stats = cells.agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") / F.sum("n")
                          - F.pow(F.sum("total") / F.sum("n"), F.lit(2)))).alias("deviation"),
        F.min("least").alias("minimum"), F.max("most").alias("maximum"))
    counts = [(row["cell"], row["n"]) for row in cells.select("cell", "n").orderBy("cell").collect()]
    size, below, wanted = sum(n for _, n in counts), 0, {}
    for cell, n in counts:
        for position in ((size + 1) // 2, size // 2 + 1):
            if below < position <= below + n:
                wanted.setdefault(cell, below)
        below += n
    if not wanted:
        return stats.where("n > 0").withColumn("median", F.lit(None).cast("double"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = (values_in_cells(questions, corpus, sorted(wanted)).groupBy("value").agg(F.sum("n").alias("n"))
              .withColumn("below", F.lit(min(wanted.values())) + F.coalesce(F.sum("n").over(w), F.lit(0))))

    def at(position):
        return F.max(F.when((F.col("below") < position) & (F.lit(position) <= F.col("below") + F.col("n")),
                            F.col("value")))

    middle = placed.agg(((at((size + 1) // 2) + at(size // 2 + 1)) / 2.0).alias("median"))
    return stats.withColumn("median", middle.scalar())
