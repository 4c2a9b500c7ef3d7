"""Identifier-lexical scores and BM25 of questions against a document corpus.

Both run from the question side: question terms are few, so documents are
only exploded to the terms some question asks for, and partial sums are
combined in the task that holds the document.

Record layout: (id, schema_text, title, columns array<string>).
Question layout: (question_id, text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.functions import text as tx
from askgrid.operators.bounded import MAX_BROADCAST_ROWS, cut, fits, in_slices, small_side

SCORE_DIGITS = 9

# Question terms held by one task.
MAX_TERMS_IN_TASK = 50_000

# Positions of the title and the schema among the fields of a record.
TITLE, SCHEMA = 0, 1

# The scores of one document.
ROW_SCHEMA = "id bigint, asked array<bigint>, scores array<double>"

# Cells of documents and questions whose sums a task holds at once.
MAX_CELLS = 4_000_000

# Stands for the document itself among its postings, so that one pass over the
# texts yields the postings, the corpus size and the mean length.
DOCUMENT_MARK = ""


def question_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term, query_frequency)."""
    return (questions.select("question_id", F.explode(tx.question_tokens(F.col("text"))).alias("term"))
            .groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("query_frequency")))


def lexical_fields(records: DataFrame, extra_tokens: DataFrame | None = None) -> DataFrame:
    """(id, fields): distinct tokens of the title, the schema and each column, in this order.

    ``extra_tokens`` (id, tokens) enriches the title tokens, as captions do.
    """
    parts = F.concat(F.array("title", "schema_text"), F.col("columns"))
    fields = records.select("id", F.transform(parts, tx.distinct_identifier_tokens).alias("fields"))
    if extra_tokens is None:
        return fields
    title = F.array_distinct(F.concat(F.get("fields", F.lit(TITLE)), F.coalesce(
        "extra", F.array().cast("array<string>"))))
    rest = F.slice("fields", F.lit(2), F.size("fields"))
    return (fields.join(extra_tokens.select("id", F.col("tokens").alias("extra")), "id", "left")
            .select("id", F.concat(F.array(title), rest).alias("fields")))


def gathered(scores: DataFrame) -> DataFrame:
    """(id, asked, scores): one row per document of (question_id, id, lexical)."""
    pairs = scores.groupBy("id").agg(F.collect_list(F.struct("question_id", "lexical")).alias("pairs"))
    return pairs.select("id", F.col("pairs.question_id").alias("asked"), F.col("pairs.lexical").alias("scores"))


def listed(rows: DataFrame) -> DataFrame:
    """(question_id, id, lexical) of rows (id, asked, scores)."""
    pairs = rows.select("id", F.explode(F.arrays_zip("asked", "scores")).alias("pair"))
    return pairs.select(F.col("pair.asked").alias("question_id"), "id", F.col("pair.scores").alias("lexical"))


def _rows_in_tasks(asked: DataFrame, fields: DataFrame) -> DataFrame:
    """Scores where the question terms are few: each document is scored in the task that reads it."""
    rows = asked.withColumn("weight", tx.token_weight(F.col("term"))).collect()
    questions = np.array(sorted({row["question_id"] for row in rows}), dtype=np.int64)
    place = {int(value): i for i, value in enumerate(questions)}
    asking: dict[str, tuple[list[int], float]] = {}
    for row in rows:
        asking.setdefault(row["term"], ([], row["weight"]))[0].append(place[row["question_id"]])
    shared = fields.sparkSession.sparkContext.broadcast(
        (questions, {term: (np.array(who), weight) for term, (who, weight) in asking.items()}))
    depth = len(fixed.COLUMN_WEIGHTS)

    def match(tokens, terms, size):
        total = np.zeros(size)
        for token in tokens:
            found = terms.get(token)
            if found is not None:
                total[found[0]] += found[1]
        return np.minimum(total, 1.0)

    def run(batches):
        ids, terms = shared.value
        size = len(ids)
        weights = np.array(fixed.COLUMN_WEIGHTS)[:, None]
        for batch in in_slices(batches):
            members, asked_by, scores = [], [], []
            for key, parts in zip(batch.column("id").to_pylist(), batch.column("fields").to_pylist()):
                best = np.zeros((depth, size))
                for tokens in parts[SCHEMA + 1:]:
                    if not len(tokens):
                        continue
                    column = match(tokens, terms, size)
                    better = np.nonzero(column > best[-1])[0]
                    if len(better):
                        best[-1, better] = column[better]
                        best[:, better] = -np.sort(-best[:, better], axis=0)
                score = np.minimum(1.0, fixed.TABLE_PART * match(parts[TITLE], terms, size)
                                   + fixed.COLUMN_PART * (best * weights).sum(axis=0)
                                   + fixed.SCHEMA_PART * match(parts[SCHEMA], terms, size))
                hit = np.nonzero(score)[0]
                if len(hit):
                    members.append(key)
                    asked_by.append(ids[hit])
                    scores.append(np.round(score[hit], SCORE_DIGITS))
            if members:
                sizes = [len(found) for found in asked_by]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(members, pa.int64()), _list_column(np.concatenate(asked_by), sizes),
                     _list_column(np.concatenate(scores), sizes)], names=["id", "asked", "scores"])

    return fields.select("id", "fields").mapInArrow(run, ROW_SCHEMA)


def _scores_by_join(asked: DataFrame, fields: DataFrame) -> DataFrame:
    """Scores for any number of question terms, joined on the term."""
    place = F.col("position")
    hits = (fields.select("id", F.posexplode("fields").alias("position", "tokens"))
            .select("id", "position", F.explode("tokens").alias("term")).join(asked, "term")
            .groupBy("question_id", "id", "position")
            .agg(F.least(F.lit(1.0), F.sum(tx.token_weight(F.col("term")))).alias("match")))
    by_pair = hits.groupBy("question_id", "id").agg(
        F.coalesce(F.max(F.when(place == TITLE, F.col("match"))), F.lit(0.0)).alias("title"),
        F.coalesce(F.max(F.when(place == SCHEMA, F.col("match"))), F.lit(0.0)).alias("schema"),
        F.sort_array(F.collect_list(F.when(place > SCHEMA, F.col("match"))), asc=False)
        .alias("columns"))
    weights = F.array(*[F.lit(weight) for weight in fixed.COLUMN_WEIGHTS])
    best = F.slice("columns", 1, len(fixed.COLUMN_WEIGHTS))
    column_part = F.aggregate(
        F.zip_with(best, weights, lambda match, weight: F.coalesce(match * weight, F.lit(0.0))),
        F.lit(0.0), lambda total, part: total + part)
    score = F.least(F.lit(1.0), fixed.TABLE_PART * F.col("title") + fixed.COLUMN_PART * column_part
                    + fixed.SCHEMA_PART * F.col("schema"))
    return by_pair.select("question_id", "id", F.round(score, SCORE_DIGITS).alias("lexical"))


def lexical_scores(questions: DataFrame, records: DataFrame,
                   extra_tokens: DataFrame | None = None) -> DataFrame:
    """(question_id, id, lexical) for every pair with a positive score.

    With few question terms, which is checked, nothing is shuffled: a document
    meets all questions in its own task. Otherwise terms are joined.
    """
    asked = question_terms(questions).select("question_id", "term")
    fields = lexical_fields(records, extra_tokens)
    if fits(asked, MAX_TERMS_IN_TASK):
        return listed(_rows_in_tasks(asked, fields))
    return _scores_by_join(asked, fields)


def lexical_rows(questions: DataFrame, records: DataFrame,
                 extra_tokens: DataFrame | None = None) -> DataFrame:
    """(id, asked, scores): the same scores, one row per document."""
    asked = question_terms(questions).select("question_id", "term")
    fields = lexical_fields(records, extra_tokens)
    if fits(asked, MAX_TERMS_IN_TASK):
        return _rows_in_tasks(asked, fields)
    return gathered(_scores_by_join(asked, fields))


def flattened_tokens(records: DataFrame, extra_tokens: DataFrame | None = None) -> DataFrame:
    """(id, tokens, length): title, schema and column tokens in one bag.

    With ``extra_tokens`` the title becomes the set of its own and the extra tokens.
    """
    title = tx.identifier_tokens(F.col("title"))
    source = records
    if extra_tokens is not None:
        source = records.join(extra_tokens.select("id", F.col("tokens").alias("extra")), "id", "left")
        title = F.array_distinct(F.concat(title, F.coalesce("extra", F.array().cast("array<string>"))))
    body = F.flatten(F.transform("columns", tx.identifier_tokens))
    tokens = F.concat(title, tx.identifier_tokens(F.col("schema_text")), body)
    return source.select("id", tokens.alias("tokens")).withColumn("length", F.size("tokens"))


def bm25_contributions(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Contribution of each question term to each document that contains it.

    ``documents`` comes from ``flattened_tokens``.
    """
    terms = question_terms(questions)
    small = fits(terms, MAX_BROADCAST_ROWS)
    vocabulary = terms.select("term").distinct()
    marked = F.array_append("tokens", F.lit(DOCUMENT_MARK))
    wanted = vocabulary.unionByName(terms.sparkSession.range(1).select(
        F.lit(DOCUMENT_MARK).alias("term")))
    postings = cut(documents.select("id", "length", F.explode(marked).alias("term"))
                   .join(small_side(wanted, small), "term", "left_semi")
                   .groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf")))
    corpus = postings.where(F.col("term") == DOCUMENT_MARK).agg(
        F.count(F.lit(1)).alias("size"), F.sum("length").alias("tokens"))
    size = corpus.select("size")
    mean_length = corpus.select(F.col("tokens") / F.col("size"))
    frequency = postings.where(F.col("term") != DOCUMENT_MARK)
    document_frequency = frequency.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(document_frequency, "term").withColumn(
        "idf", F.log(1.0 + (size.scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    relative = F.col("length") / mean_length.scalar()
    denominator = F.col("tf") + fixed.BM25_K1 * (1.0 - fixed.BM25_B + fixed.BM25_B * relative)
    contribution = (F.col("query_frequency") * F.col("idf")
                    * (F.col("tf") * (fixed.BM25_K1 + 1.0) / denominator))
    return (frequency.join(small_side(weighted, small), "term")
            .select("question_id", "id", "term", "query_frequency", "tf", "df", "idf",
                    contribution.alias("contribution")))


def bm25_scores(contributions: DataFrame) -> DataFrame:
    """(question_id, id, bm25_raw, lexical): raw scores and scores over the question's maximum."""
    raw = contributions.groupBy("question_id", "id").agg(
        F.round(F.sum("contribution"), SCORE_DIGITS).alias("bm25_raw"))
    top = raw.groupBy("question_id").agg(F.max("bm25_raw").alias("top"))
    return (raw.join(top, "question_id")
            .select("question_id", "id", "bm25_raw", F.when(
                F.col("top") > 0, F.round(F.col("bm25_raw") / F.col("top"), SCORE_DIGITS))
                .otherwise(F.lit(0.0)).alias("lexical")))


def _list_column(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every entry of a list column without nulls in it."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()


def _counted_terms(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id, length, terms, tfs): places of the vocabulary in each document and how often they occur.

    The length is counted here, so that the tokens of a text are made once only.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        words = pa.array(shared.value, pa.string())
        for batch in batches:
            if batch.column("tokens").null_count:
                batch = batch.filter(batch.column("tokens").is_valid())
            tokens = batch.column("tokens")
            length = np.diff(tokens.offsets.to_numpy())
            row = np.repeat(np.arange(len(tokens)), length)
            place = pc.index_in(tokens.flatten(), value_set=words)
            held = place.is_valid().to_numpy(zero_copy_only=False)
            key = row[held] * len(words) + place.drop_null().to_numpy()
            found, times = np.unique(key, return_counts=True)
            sizes = np.bincount(found // max(len(words), 1), minlength=len(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(length, pa.int32()),
                 _list_column((found % max(len(words), 1)).astype(np.int32), sizes),
                 _list_column(times.astype(np.int64), sizes)], names=["id", "length", "terms", "tfs"])

    counted = documents.select("id", "tokens").mapInArrow(
        run, "id bigint, length int, terms array<int>, tfs array<bigint>")
    return counted.groupBy("id", "length").agg(
        F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("tfs")).alias("tfs"))


def bm25_rows(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, asked, raw, scores): BM25 of each document, raw and over the question's maximum.

    With few question terms, which is checked, a document is one row throughout:
    its question terms are counted in the task that reads it, and it meets all
    questions in one task. Otherwise contributions are joined and summed.
    """
    terms = question_terms(questions)
    if not fits(terms, MAX_TERMS_IN_TASK):
        pairs = bm25_scores(bm25_contributions(questions, documents)).groupBy("id").agg(
            F.collect_list(F.struct("question_id", "bm25_raw", "lexical")).alias("pairs"))
        return pairs.select("id", F.col("pairs.question_id").alias("asked"), F.col("pairs.bm25_raw").alias("raw"),
                            F.col("pairs.lexical").alias("scores"))
    spark, asking = documents.sparkSession, terms.collect()
    vocabulary = sorted({row["term"] for row in asking})
    places = {term: place for place, term in enumerate(vocabulary)}
    ids = sorted({row["question_id"] for row in asking})
    columns = {question: column for column, question in enumerate(ids)}
    postings = cut(_counted_terms(documents, vocabulary))
    corpus = postings.agg(F.count(F.lit(1)).alias("size"), F.avg("length").alias("mean")).first()
    frequency = {row["term"]: row["df"] for row in postings.select(
        F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    links = sorted((places[row["term"]], columns[row["question_id"]], row["query_frequency"]) for row in asking)
    term, column, times = np.array(links, dtype=np.int64).reshape(-1, 3).T
    df = np.array([frequency.get(place, 0) for place in range(len(vocabulary))], dtype=np.float64)
    idf = np.log(1.0 + (corpus["size"] - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((
        np.array(ids, dtype=np.int64), np.searchsorted(term, np.arange(len(vocabulary) + 1)), column,
        times * idf[term], corpus["mean"]))

    def run(batches):
        questions, edges, asked_by, weights, mean = shared.value
        width = len(questions)
        step = max(1, MAX_CELLS // max(width, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                row, place = _flat(part.column("terms"))
                key, entry = np.unique(row * (len(edges) - 1) + place, return_inverse=True)
                tf = np.bincount(entry, weights=part.column("tfs").flatten().to_numpy(), minlength=len(key))
                row, place = key // max(len(edges) - 1, 1), key % max(len(edges) - 1, 1)
                relative = part.column("length").to_numpy()[row] / mean
                gain = tf * (fixed.BM25_K1 + 1.0) / (
                    tf + fixed.BM25_K1 * (1.0 - fixed.BM25_B + fixed.BM25_B * relative))
                number = edges[place + 1] - edges[place]
                link = np.repeat(edges[place] - (np.cumsum(number) - number), number) + np.arange(number.sum())
                cell = np.repeat(row, number) * width + asked_by[link]
                total = np.bincount(cell, weights=np.repeat(gain, number) * weights[link],
                                    minlength=part.num_rows * width)
                hit = np.unique(cell)
                sizes = np.bincount(hit // max(width, 1), minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), _list_column(questions[hit % max(width, 1)], sizes),
                     _list_column(total[hit], sizes)], names=["id", "asked", "raw"])

    summed = cut(postings.mapInArrow(run, "id bigint, asked array<bigint>, raw array<double>")
                 .where("size(asked) > 0"))
    if not summed.groupBy("id").count().where("count > 1").isEmpty():
        both = summed.select("id", F.explode(F.arrays_zip("asked", "raw")).alias("pair"))
        both = both.groupBy("id", F.col("pair.asked").alias("question_id")).agg(F.sum("pair.raw").alias("lexical"))
        summed = cut(gathered(both).withColumnRenamed("scores", "raw"))
    best = dict(listed(summed.withColumnRenamed("raw", "scores")).groupBy("question_id").agg(
        F.max("lexical")).collect())
    tops = spark.sparkContext.broadcast((
        np.array(sorted(best), dtype=np.int64), np.round([best[question] for question in sorted(best)], SCORE_DIGITS)))

    def scaled(batches):
        questions, top = tops.value
        for batch in batches:
            _, asked = _flat(batch.column("asked"))
            raw = np.round(batch.column("raw").flatten().to_numpy(), SCORE_DIGITS)
            most = top[np.searchsorted(questions, asked)]
            share = np.where(most > 0, np.round(raw / np.where(most > 0, most, 1.0), SCORE_DIGITS), 0.0)
            sizes = np.diff(batch.column("asked").offsets.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("asked"), _list_column(raw, sizes), _list_column(share, sizes)],
                names=["id", "asked", "raw", "scores"])

    return summed.mapInArrow(scaled, "id bigint, asked array<bigint>, raw array<double>, scores array<double>")


def best_rows(rows: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """(question_id, id, lexical) of rows (id, asked, scores): the best k per question of each batch.

    Best by (score, id) descending. Raw scores come along as ``bm25_raw``. With
    ``distinct`` an id counts once per question.
    """
    carried = "raw" in rows.columns
    names = ["question_id", "id", "lexical", *(["bm25_raw"] if carried else [])]
    schema = "question_id bigint, id bigint, lexical double" + (", bm25_raw double" if carried else "")

    def run(batches):
        for batch in batches:
            row, asked = _flat(batch.column("asked"))
            score = batch.column("scores").flatten().to_numpy()
            key = batch.column("id").fill_null(-(1 << 63) + 1).to_numpy()[row]
            kept = np.arange(len(key))
            if distinct:
                kept = np.lexsort((-score, key, asked))
                kept = kept[np.append(True, (np.diff(asked[kept]) != 0) | (np.diff(key[kept]) != 0))[:len(kept)]]
            order = kept[np.lexsort((-key[kept], -score[kept], asked[kept]))]
            starts = np.searchsorted(asked[order], asked[order])
            chosen = order[np.arange(len(order)) - starts < k]
            columns = [pa.array(asked[chosen]), batch.column("id").take(pa.array(row[chosen])), pa.array(score[chosen])]
            if carried:
                columns.append(batch.column("raw").flatten().take(pa.array(chosen)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("id", "asked", "scores", *(["raw"] if carried else [])).mapInArrow(run, schema)


def saturation(scores: DataFrame, column: str, corpus_size: DataFrame) -> DataFrame:
    """Per question: maximum, rows at and near it, and the spread of the best twenty.

    ``scores`` holds the positive scores only, as pairs or as rows (id, asked,
    scores); the remaining documents of the corpus score zero. ``corpus_size``
    is a one-cell frame.
    """
    if "asked" in scores.columns:
        leading, scores = best_rows(scores, fixed.SPREAD_DEPTH), listed(scores)
    else:
        scores = leading = cut(scores)
    top = cut(scores.groupBy("question_id").agg(F.max(column).alias("maximum")))
    counted = (scores.join(small_side(top, fits(top, MAX_BROADCAST_ROWS)), "question_id").groupBy("question_id").agg(
        F.max("maximum").alias("maximum"),
        F.count_if(F.abs(F.col(column) - F.col("maximum")) <= fixed.SATURATION_TOLERANCE)
        .alias("at_maximum"),
        F.count_if(F.col(column) >= fixed.SATURATION_SHARE * F.col("maximum")
                   - fixed.SATURATION_TOLERANCE).alias("near_maximum")))
    w = Window.partitionBy("question_id").orderBy(F.desc(column), "id")
    best = (leading.withColumn("n", F.row_number().over(w))
            .where(F.col("n") <= fixed.SPREAD_DEPTH)
            .groupBy("question_id").agg(F.count(F.lit(1)).alias("held"),
                                        F.min(column).alias("lowest")))
    depth = F.least(F.lit(fixed.SPREAD_DEPTH), corpus_size.scalar())
    lowest = F.when(F.col("held") < depth, F.lit(0.0)).otherwise(F.col("lowest"))
    return (counted.join(best, "question_id")
            .select("question_id", "maximum", "at_maximum", "near_maximum",
                    F.round(F.col("maximum") - lowest, SCORE_DIGITS).alias("top_spread")))
