"""Retrieval metrics.

A case is one question. Its expected members are the documents of quality 1
that ``lineitem`` relates to it (part to supplier). Rankings come from
the retrieval operators; metrics are joins and aggregates over (case, rank)
rows, so no per-case list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from askgrid.functions import fixed_values as fixed
from askgrid.operators import dense, metrics
from askgrid.operators.bounded import cut
from askgrid.operators.quantiles import nearest_rank, median
from askgrid.plans import retrieval as r
from askgrid.plans import retrieval_sql as sql
from askgrid.plans.registry import query

CASE_CTES = """
cases AS (
  SELECT item_id AS question_id, label, CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium'
         ELSE 'hard' END AS difficulty,
         CASE WHEN label < 9 THEN 'domain ' || label END AS domain
  FROM benchmark JOIN embeddings ON vec_id = item_id),
expected AS (
  SELECT DISTINCT l_partkey AS question_id, l_suppkey AS id FROM lineitem
  JOIN labels ON doc_id = l_suppkey
  WHERE quality = 1 AND l_suppkey <> l_partkey AND l_partkey IN (SELECT question_id FROM cases))"""

DENSE_RANKS = """
dense_rank AS (SELECT question_id, id, cosine, row_number() OVER (
  PARTITION BY question_id ORDER BY cosine DESC, id DESC) AS rank FROM dense)"""


def cases(t):
    vectors = t.embeddings.select("vec_id", "label")
    return t.benchmark.select("item_id").join(vectors, F.col("vec_id") == F.col("item_id")).select(
        F.col("item_id").alias("question_id"), "label",
        F.when(F.col("item_id") % 3 == 0, "easy").when(F.col("item_id") % 3 == 1, "medium")
        .otherwise("hard").alias("difficulty"),
        F.when(F.col("label") < 9, F.concat(F.lit("domain "), F.col("label"))).alias("domain"))


def expected(t):
    """Related documents of each question; only lines of questions reach the deduplication."""
    asked = cases(t).select(F.col("question_id").alias("l_partkey"))
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("l_suppkey"))
    return (t.lineitem.select("l_partkey", "l_suppkey").where("l_partkey <> l_suppkey")
            .join(r.cand.broadcast_if_small(asked), "l_partkey", "left_semi").distinct()
            .join(good, "l_suppkey", "left_semi")
            .select(F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("id")))


def dense_ranking(t, depth):
    return dense.dense_top(r.questions_with_vectors(t), r.corpus(t), depth).select(
        "question_id", "id", "rank", "cosine", "dense")


def graph_ranking(t, depth):
    return r.expanded(t, r.lexical_rows_for(t), depth).select("question_id", "id", "rank")


def recall_sql(ranking: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT c.question_id, c.difficulty, c.domain, count(e.id) AS expected_count, count(k.id) AS found,
         CAST(count(k.id) AS DOUBLE) / nullif(count(e.id), 0) AS recall
  FROM cases c JOIN expected e ON e.question_id = c.question_id
  LEFT JOIN {ranking} k ON k.question_id = e.question_id AND k.id = e.id AND k.rank <= 10
  GROUP BY ALL)"""


@query("recall_at_k", sql.with_ctes(CASE_CTES, sql.DENSE, DENSE_RANKS, recall_sql("dense_rank", "rec"),
                                    select="""
SELECT question_id, expected_count, found, expected_count - found AS missing,
       round(recall, 6) AS recall, found = expected_count AS full_coverage FROM rec"""))
def recall_at_k(t):
    """Recall@10, missing members and full coverage per case."""
    return metrics.recall(expected(t), dense_ranking(t, 10), 10).select(
        "question_id", "expected_count", "found",
        (F.col("expected_count") - F.col("found")).alias("missing"),
        F.round("recall", 6).alias("recall"),
        (F.col("found") == F.col("expected_count")).alias("full_coverage"))


@query("macro_recall", sql.with_ctes(CASE_CTES, sql.DENSE, DENSE_RANKS,
                                     recall_sql("dense_rank", "rec"), select="""
SELECT grouping_name, group_value, count(*) AS question_count, round(avg(recall), 6) AS macro_recall,
       count(*) FILTER (found = expected_count) AS full_coverage_count FROM (
  SELECT *, 'overall' AS grouping_name, 'overall' AS group_value FROM rec
  UNION ALL SELECT *, 'difficulty', difficulty FROM rec
  UNION ALL SELECT *, 'domain', domain FROM rec WHERE domain IS NOT NULL)
GROUP BY grouping_name, group_value"""))
def macro_recall(t):
    """Macro recall overall, by difficulty and by domain; cases without a domain drop out there."""
    per_case = metrics.recall(expected(t), dense_ranking(t, 10), 10).join(cases(t), "question_id")
    return metrics.macro(per_case, ["difficulty", "domain"])


SYSTEMS = ("dense", "hybrid", "graph", "bm25 hybrid", "alias hybrid", "chunked")
UNIONS = {"dense + graph": ("dense", "graph"), "dense + bm25 hybrid": ("dense", "bm25 hybrid"),
          "hybrid + chunked": ("hybrid", "chunked")}
_UNION_ROWS = ", ".join(f"('{name}', '{part}')" for name, parts in UNIONS.items() for part in parts)

COVERAGE_SQL = sql.with_ctes(
    CASE_CTES, *r.LEXICAL_CTES, sql.lexical(), sql.DENSE, DENSE_RANKS, sql.hybrid(), sql.EDGES,
    sql.reached(), sql.expansion(), sql.bm25(), sql.hybrid("bm25", "bm25_hybrid"), sql.ALIASES,
    sql.lexical("enriched_tokens", "alias_lexical"), sql.hybrid("alias_lexical", "alias_hybrid"),
    r.CHUNK_SQL, f"""
chunk_rank AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, id DESC) AS rank
               FROM pooled),
single AS (
  SELECT 'dense' AS system, question_id, id, rank FROM dense_rank
  UNION ALL SELECT 'hybrid', question_id, id, rank FROM hybrid
  UNION ALL SELECT 'graph', question_id, id, rank FROM graph
  UNION ALL SELECT 'bm25 hybrid', question_id, id, rank FROM bm25_hybrid
  UNION ALL SELECT 'alias hybrid', question_id, id, rank FROM alias_hybrid
  UNION ALL SELECT 'chunked', question_id, id, rank FROM chunk_rank),
unions (name, part) AS (VALUES {_UNION_ROWS}),
memberships AS (
  SELECT * FROM single WHERE rank <= 200
  UNION ALL SELECT name, question_id, id, min(rank) FROM single JOIN unions ON part = system
            WHERE rank <= 200 GROUP BY ALL),
depths AS (SELECT unnest([10, 20, 50, 100, 200]) AS depth),
systems AS (SELECT DISTINCT system FROM single UNION SELECT name FROM unions),
per_case AS (
  SELECT s.system, d.depth, e.question_id, count(*) AS n, count(m.id) AS found
  FROM expected e CROSS JOIN depths d CROSS JOIN systems s
  LEFT JOIN memberships m ON m.system = s.system AND m.question_id = e.question_id AND m.id = e.id
    AND m.rank <= d.depth GROUP BY ALL)""", select="""
SELECT system, CAST(depth AS INTEGER) AS depth, count(*) AS cases,
  round(avg(CAST(found AS DOUBLE) / n), 6) AS candidate_recall,
  count(*) FILTER (found = n) AS every_expected, count(*) FILTER (found > 0) AS any_expected,
  CAST(sum(n - found) AS BIGINT) AS absent FROM per_case GROUP BY ALL""")


@query("coverage_by_depth", COVERAGE_SQL)
def coverage_by_depth(t):
    """Coverage of six systems and three unions at five depths.

    Each expected member meets a ranking once; the depths are conditional
    counts on its rank, not copies of the rows.
    """
    asked, vectors, lexical = r.questions_with_vectors(t), r.corpus(t), r.lexical_rows_for(t)
    most = max(fixed.COVERAGE_DEPTHS)
    found = {"dense": dense_ranking(t, most), "hybrid": dense.hybrid_top(asked, vectors, lexical, most),
             "graph": r.expanded(t, lexical, most),
             "bm25 hybrid": dense.hybrid_top(asked, vectors, r.bm25_for(t), most),
             "alias hybrid": dense.hybrid_top(asked, vectors, r.lexical_rows_for(t, r.alias_terms(t)), most),
             "chunked": dense.pooled_top(asked, r.chunks(t), most)}
    rankings = {name: found[name].select("question_id", "id", "rank") for name in SYSTEMS}
    return metrics.coverage(expected(t), rankings, UNIONS, fixed.COVERAGE_DEPTHS)


@query("rank_classes", sql.with_ctes(CASE_CTES, sql.DENSE, DENSE_RANKS, select="""
SELECT CASE WHEN rank IS NULL OR rank > 200 THEN 'absent beyond 200' WHEN rank <= 20 THEN 'easy candidate'
  WHEN rank <= 50 THEN 'moderate candidate' WHEN rank <= 100 THEN 'broad candidate'
  ELSE 'very broad candidate' END AS rank_class, count(*) AS members
FROM expected LEFT JOIN dense_rank USING (question_id, id) GROUP BY ALL"""))
def rank_classes(t):
    return (expected(t).join(dense_ranking(t, 200), ["question_id", "id"], "left")
            .groupBy(metrics.rank_class(F.col("rank")).alias("rank_class"))
            .agg(F.count(F.lit(1)).alias("members")))


@query("candidate_counts", sql.with_ctes(*r.CANDIDATE_CTES, select="""
, n AS (SELECT question_id, count(*) AS n FROM candidates GROUP BY 1)
SELECT count(*) AS questions, min(n) AS minimum, max(n) AS maximum, CAST(sum(n) AS BIGINT) AS pairs,
       CAST(sum(n) AS DOUBLE) / count(*) AS mean, CAST(median(n) AS DOUBLE) AS median,
       count(*) * 50 AS pair_lower_bound, count(*) * 100 AS pair_upper_bound FROM n"""))
def candidate_counts(t):
    """Unique candidates per question and the bounds of the pair cost."""
    counts = r.candidates_for(t).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("questions"), F.min("n").alias("minimum"),
        F.max("n").alias("maximum"), F.sum("n").alias("pairs"),
        (F.sum("n").cast("double") / F.count(F.lit(1))).alias("mean"),
        F.median("n").alias("median"),
        (F.count(F.lit(1)) * fixed.CANDIDATE_DEPTH).alias("pair_lower_bound"),
        (F.count(F.lit(1)) * 2 * fixed.CANDIDATE_DEPTH).alias("pair_upper_bound"))


@query("miss_classes", sql.with_ctes(CASE_CTES, *r.CANDIDATE_CTES, r.RERANK_CTES, select="""
SELECT e.question_id, count(*) AS expected_count, count(c.id) AS candidate_expected,
  count(*) FILTER (r.rank <= 10) AS found,
  count(*) FILTER (c.id IS NULL) AS candidate_generation_failures,
  count(*) FILTER (c.id IS NOT NULL AND r.rank > 10) AS reranker_failures,
  count(c.id) > 10 AS capacity_limited,
  round(CAST(least(10, count(c.id)) AS DOUBLE) / count(*), 6) AS oracle_recall,
  round(CAST(least(10, count(c.id)) - count(*) FILTER (r.rank <= 10) AS DOUBLE) / count(*), 6)
    AS oracle_gap
FROM expected e LEFT JOIN candidates c ON c.question_id = e.question_id AND c.id = e.id
LEFT JOIN reranked r ON r.question_id = e.question_id AND r.id = e.id GROUP BY ALL"""))
def miss_classes(t):
    """Why expected members are missing after reranking, and the reachable recall."""
    candidates = cut(r.candidates_for(t))
    ranked = r.cand.rerank(r.cand.score_candidates(
        candidates, r.all_questions(t), r.lexical.flattened_tokens(r.records(t))))
    return metrics.miss_classes(expected(t), candidates, ranked, fixed.FINAL_DEPTH)


@query("transitions", sql.with_ctes(
    CASE_CTES, *r.LEXICAL_CTES, sql.lexical(), sql.DENSE, DENSE_RANKS, sql.hybrid(),
    recall_sql("dense_rank", "old_rec"), recall_sql("hybrid", "new_rec"), """
changes AS (
  SELECT e.question_id, count(*) FILTER (n.rank <= 10 AND (o.rank > 10)) AS gained,
         count(*) FILTER (o.rank <= 10 AND (n.rank > 10)) AS lost
  FROM expected e LEFT JOIN dense_rank o USING (question_id, id)
  LEFT JOIN hybrid n USING (question_id, id) GROUP BY ALL)""", select="""
SELECT question_id, round(o.recall, 6) AS old_recall, round(n.recall, 6) AS new_recall,
  CASE WHEN n.recall > o.recall THEN 'improved' WHEN n.recall < o.recall THEN 'regressed'
       ELSE 'unchanged' END AS transition, gained, lost
FROM old_rec o JOIN new_rec n USING (question_id) JOIN changes USING (question_id)"""))
def transitions(t):
    """Improved, unchanged and regressed cases between two systems, with members gained and lost."""
    hybrid = dense.hybrid_top(r.questions_with_vectors(t), r.corpus(t), r.lexical_rows_for(t), 10)
    return metrics.transitions(expected(t), dense_ranking(t, 10), hybrid, 10)


@query("transition_members", sql.with_ctes(
    CASE_CTES, *r.LEXICAL_CTES, sql.lexical(), sql.DENSE, DENSE_RANKS, sql.hybrid(), select="""
SELECT e.question_id, e.id, CASE WHEN n.rank <= 10 THEN 'gained' ELSE 'lost' END AS status,
  CAST(o.rank AS INTEGER) AS old_rank, CAST(n.rank AS INTEGER) AS new_rank
FROM expected e
LEFT JOIN (SELECT * FROM dense_rank WHERE rank <= 200) o ON o.question_id = e.question_id AND o.id = e.id
LEFT JOIN (SELECT * FROM hybrid WHERE rank <= 200) n ON n.question_id = e.question_id AND n.id = e.id
WHERE coalesce(o.rank <= 10, false) <> coalesce(n.rank <= 10, false)"""))
def transition_members(t):
    """Expected members that enter or leave the Top-10, with both ranks (null beyond 200)."""
    most = max(fixed.COVERAGE_DEPTHS)
    new = dense.hybrid_top(r.questions_with_vectors(t), r.corpus(t), r.lexical_rows_for(t), most)
    return metrics.changed_members(expected(t), dense_ranking(t, most), new, 10)


@query("rank_movement", sql.with_ctes(
    *r.LEXICAL_CTES, sql.lexical(), sql.DENSE, DENSE_RANKS, sql.hybrid(), select="""
SELECT coalesce(o.question_id, n.question_id) AS question_id, coalesce(o.id, n.id) AS id,
  CAST(o.rank AS INTEGER) AS old_rank, CAST(n.rank AS INTEGER) AS new_rank,
  CAST(o.rank - n.rank AS INTEGER) AS moved_up
FROM (SELECT * FROM dense_rank WHERE rank <= 50) o
FULL JOIN (SELECT * FROM hybrid WHERE rank <= 50) n ON o.question_id = n.question_id AND o.id = n.id"""))
def rank_movement(t):
    """Rank of each member of either Top-50 before and after fusion."""
    new = dense.hybrid_top(r.questions_with_vectors(t), r.corpus(t), r.lexical_rows_for(t), 50)
    old = dense_ranking(t, 50)
    return (old.select("question_id", "id", F.col("rank").alias("old_rank"))
            .join(new.select("question_id", "id", F.col("rank").alias("new_rank")),
                  ["question_id", "id"], "full")
            .withColumn("moved_up", F.col("old_rank") - F.col("new_rank")))


@query("ranking_signature", sql.with_ctes(
    *r.LEXICAL_CTES, sql.lexical(), sql.DENSE, DENSE_RANKS, sql.hybrid(), """
runs AS (
  SELECT 'same run' AS prior, d.question_id, d.rank, d.id AS id, o.id AS old_id
  FROM (SELECT * FROM dense_rank WHERE rank <= 10) d
  FULL JOIN (SELECT * FROM dense_rank WHERE rank <= 10) o USING (question_id, rank)
  UNION ALL
  SELECT 'before fusion', coalesce(h.question_id, d.question_id), coalesce(h.rank, d.rank), h.id, d.id
  FROM (SELECT * FROM hybrid WHERE rank <= 10) h
  FULL JOIN (SELECT * FROM dense_rank WHERE rank <= 10) d
  ON h.question_id = d.question_id AND h.rank = d.rank)""", select="""
SELECT prior, question_id, count(*) AS compared, count(*) FILTER (id IS DISTINCT FROM old_id) AS differences
FROM runs GROUP BY ALL"""))
def ranking_signature(t):
    """A ranking compared with a stored prior run, rank by rank: its own and the one before fusion."""
    stored = cut(dense_ranking(t, 10).select("question_id", "rank", F.col("id").alias("old_id")))
    again = dense_ranking(t, 10).select("question_id", "rank", "id")
    fused = dense.hybrid_top(r.questions_with_vectors(t), r.corpus(t), r.lexical_rows_for(t), 10).select(
        "question_id", "rank", "id")
    parts = [run.join(stored, ["question_id", "rank"], "full").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(~F.col("id").eqNullSafe(F.col("old_id"))).alias("differences"))
        .withColumn("prior", F.lit(name)) for name, run in (("same run", again), ("before fusion", fused))]
    return parts[0].unionByName(parts[1])


@query("score_distribution", sql.with_ctes(CASE_CTES, sql.DENSE, select="""
SELECT kind, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation,
       min(v) AS minimum, max(v) AS maximum, round(median(v), 6) AS median FROM (
  SELECT 'cosine' AS kind, cosine AS v FROM dense
  UNION ALL SELECT 'expected', cosine FROM dense JOIN expected USING (question_id, id)
  UNION ALL SELECT 'top spread', s FROM (
    SELECT max(cosine) FILTER (n = 1) - max(cosine) FILTER (n = 10) AS s FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC) AS n FROM dense)
    GROUP BY question_id)) GROUP BY kind"""))
def score_distribution(t):
    """Distribution of all cosines, of the expected ones and of the Top-10 spread.

    The grid of questions and documents is summed up inside each batch; only
    counts per score range leave it.
    """
    asked, vectors = r.questions_with_vectors(t), r.corpus(t)
    good = dense.score_pairs(expected(t), asked, vectors, None).select(
        F.lit("expected").alias("kind"), F.col("cosine").alias("v"))
    top = (dense_ranking(t, 10).groupBy("question_id")
           .agg((F.max("cosine") - F.min("cosine")).alias("v"), F.count(F.lit(1)).alias("held"))
           .select(F.lit("top spread").alias("kind"), F.when(F.col("held") == 10, F.col("v")).alias("v")))
    values = good.unionByName(top)
    stats = values.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"),
        F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    middle = median(values, ["kind"], "v", F.floor(F.col("v") * 1000))
    columns = ["kind", "n", *[F.round(name, 6).alias(name) for name in ("mean", "deviation")],
               "minimum", "maximum", F.round("median", 6).alias("median")]
    return (dense.distribution(asked, vectors).withColumn("kind", F.lit("cosine")).select(*columns)
            .unionByName(stats.join(middle, "kind").select(*columns)))


@query("spearman_bias", """
WITH d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT item_id AS question_id, CAST(embedding AS DOUBLE[]) AS qv
      FROM benchmark JOIN embeddings ON vec_id = item_id),
sizes AS (SELECT doc_id AS id, len(string_split(text, chr(10))) AS n FROM documents),
s AS (SELECT question_id, vec_id AS id, n, round(list_dot_product(v, qv), 9) AS score
      FROM q, d JOIN sizes ON sizes.id = vec_id),
ranked AS (
  SELECT question_id,
    rank() OVER (PARTITION BY question_id ORDER BY n)
      + (count(*) OVER (PARTITION BY question_id, n) - 1) / 2.0 AS rn,
    rank() OVER (PARTITION BY question_id ORDER BY score)
      + (count(*) OVER (PARTITION BY question_id, score) - 1) / 2.0 AS rs FROM s)
SELECT question_id, round(coalesce(corr(rn, rs), 0), 6) AS spearman FROM ranked GROUP BY question_id""")
def spearman_bias(t):
    """Rank correlation of document size with similarity, per question."""
    sizes = t.documents.select(F.col("doc_id").alias("id"),
                               F.size(F.split("text", "\n")).alias("n"))
    # The rank of a size is the same for every question: ranked once per document.
    sized = cut(metrics.average_rank(r.corpus(t).select("id").join(sizes, "id"), [], "n", "rn", F.col("n")))
    scored = cut(dense.score_all(r.questions_with_vectors(t), r.corpus(t)))
    ranked = metrics.average_rank(scored.join(sized.select("id", "rn"), "id"), ["question_id"], "cosine",
                                  "rs", F.floor(F.col("cosine") * 1000))
    return ranked.groupBy("question_id").agg(
        F.round(F.coalesce(F.corr("rn", "rs"), F.lit(0.0)), 6).alias("spearman"))


@query("latency_percentiles", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS maximum,
  CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(value, 0.9) AS DOUBLE) AS p90,
  round(CAST(median(value) AS DOUBLE), 6) AS median
FROM events GROUP BY event_type""")
def latency_percentiles(t):
    """Mean, maximum, median and nearest-rank percentiles per system."""
    stats = t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"),
        F.max("value").alias("maximum"))
    bucket = F.floor(F.col("value"))
    tail = nearest_rank(t.events, ["event_type"], "value", bucket, {"p95": 0.95, "p90": 0.9})
    middle = median(t.events, ["event_type"], "value", bucket)
    return stats.join(tail, "event_type").join(
        middle.select("event_type", F.round("median", 6).alias("median")), "event_type")


EVIDENCE_WORDS_SQL = r"""(SELECT DISTINCT {key}, lower(word) AS word FROM (
    SELECT {key}, unnest(regexp_extract_all(regexp_replace({value}, '([a-z0-9])([A-Z])', '\1 \2', 'g'),
      '[A-Za-z][A-Za-z0-9]*')) AS word FROM {table})
  WHERE length(word) > 2 AND lower(word) NOT IN ('a', 'an', 'and', 'as', 'at', 'be', 'by', 'each',
    'for', 'from', 'in', 'including', 'into', 'is', 'it', 'of', 'on', 'only', 'or', 'show', 'the',
    'their', 'to', 'with'))"""


@query("evidence_overlap", sql.with_ctes(CASE_CTES, sql.DENSE, DENSE_RANKS, f"""
asked AS {EVIDENCE_WORDS_SQL.format(key="item_id", value="text", table="benchmark")},
held AS {EVIDENCE_WORDS_SQL.format(key="doc_id", value="text", table="documents")},
missed AS (SELECT e.question_id, e.id FROM expected e JOIN dense_rank d
           ON d.question_id = e.question_id AND d.id = e.id WHERE d.rank > 10)""", select="""
SELECT m.question_id, m.id, count(*) AS shared_words, string_agg(a.word, ',' ORDER BY a.word) AS words
FROM missed m JOIN asked a ON a.item_id = m.question_id
JOIN held h ON h.doc_id = m.id AND h.word = a.word GROUP BY ALL"""))
def evidence_overlap(t):
    """For each missed expected member: question words its text does contain."""
    missed = expected(t).join(dense_ranking(t, 10), ["question_id", "id"], "left_anti")
    asked = t.benchmark.select(F.col("item_id").alias("question_id"),
                               metrics.evidence_words(F.col("text")).alias("asked"))
    held = t.documents.select(F.col("doc_id").alias("id"),
                              metrics.evidence_words(F.col("text")).alias("held"))
    shared = F.array_sort(F.array_intersect("asked", "held"))
    return (missed.join(asked, "question_id").join(held, "id")
            .withColumn("shared", shared).where(F.size("shared") > 0)
            .select("question_id", "id", F.size("shared").cast("bigint").alias("shared_words"),
                    F.array_join("shared", ",").alias("words")))


OUTCOME_CASES = """
outcomes AS (
  SELECT event_id AS case_id, CASE event_type WHEN 'purchase' THEN 'EXECUTION_CORRECT'
    WHEN 'view' THEN 'RESULT_MISMATCH' WHEN 'click' THEN 'EXECUTION_CORRECT'
    WHEN 'signup' THEN 'VALIDATION_REJECTED' ELSE 'EXECUTION_ERROR' END AS outcome,
    value < 5 AS empty_gold, user_id % 10 AS run FROM events)"""


@query("execution_accuracy", "WITH" + OUTCOME_CASES + """
SELECT run, count(*) AS case_count, count(*) FILTER (outcome = 'EXECUTION_CORRECT') AS correct,
  count(*) FILTER (outcome = 'RESULT_MISMATCH') AS mismatched,
  count(*) FILTER (outcome = 'EXECUTION_ERROR') AS failed,
  count(*) FILTER (outcome = 'VALIDATION_REJECTED') AS rejected,
  CASE WHEN run = 7 THEN 'BLOCKED' ELSE 'COMPLETE' END AS publication_status,
  CASE WHEN run <> 7 THEN round(CAST(count(*) FILTER (outcome = 'EXECUTION_CORRECT') AS DOUBLE)
    / count(*), 6) END AS execution_accuracy,
  count(*) FILTER (empty_gold) AS empty_count,
  count(*) FILTER (empty_gold AND outcome = 'EXECUTION_CORRECT') AS empty_correct,
  count(*) FILTER (NOT empty_gold) AS nonempty_count,
  count(*) FILTER (NOT empty_gold AND outcome = 'EXECUTION_CORRECT') AS nonempty_correct
FROM outcomes GROUP BY run""")
def execution_accuracy(t):
    """Outcome counts per run; a blocked case withholds the accuracy, the denominator is fixed."""
    outcome = (F.when(F.col("event_type").isin("purchase", "click"), "EXECUTION_CORRECT")
               .when(F.col("event_type") == "view", "RESULT_MISMATCH")
               .when(F.col("event_type") == "signup", "VALIDATION_REJECTED")
               .otherwise("EXECUTION_ERROR"))
    records = t.events.select((F.col("user_id") % 10).alias("run"), outcome.alias("outcome"),
                              (F.col("value") < 5).alias("empty_gold"))
    denominators = records.groupBy("run").agg(
        (F.count(F.lit(1)) + F.when(F.col("run") == 7, 1).otherwise(0)).alias("denominator"))
    return metrics.execution_accuracy(records, denominators, ["run"])


@query("outcome_mapping", """
SELECT stage, outcome, count(*) AS n FROM (
  SELECT CASE event_type WHEN 'click' THEN 'GENERATION' WHEN 'view' THEN 'VALIDATION'
    WHEN 'purchase' THEN 'GOLD_EXECUTION' WHEN 'error' THEN 'PREDICTION_EXECUTION'
    ELSE 'RETRIEVAL' END AS stage,
  CASE event_type WHEN 'click' THEN 'GENERATION_ERROR'
    WHEN 'view' THEN CASE WHEN value > 40 THEN 'EVALUATION_LIMIT' ELSE 'VALIDATION_REJECTED' END
    WHEN 'purchase' THEN CASE WHEN value > 40 THEN 'EVALUATION_LIMIT' ELSE 'EVALUATION_BLOCKED' END
    WHEN 'error' THEN CASE WHEN value > 40 THEN 'EVALUATION_LIMIT' ELSE 'EXECUTION_ERROR' END
    ELSE CASE WHEN value > 40 THEN 'EVALUATION_LIMIT' ELSE 'GENERATION_ERROR' END END AS outcome
  FROM events) GROUP BY ALL""")
def outcome_mapping(t):
    """Outcome of a failed case from its stage and error code."""
    stage = (F.when(F.col("event_type") == "click", "GENERATION")
             .when(F.col("event_type") == "view", "VALIDATION")
             .when(F.col("event_type") == "purchase", "GOLD_EXECUTION")
             .when(F.col("event_type") == "error", "PREDICTION_EXECUTION").otherwise("RETRIEVAL"))
    code = F.when(F.col("value") > 40, "RESOURCE_LIMIT_INCOMPLETE_RESULT").otherwise("PARSE_ERROR")
    return (t.events.select(stage.alias("stage"), code.alias("code"))
            .groupBy("stage", metrics.outcome(F.col("stage"), F.col("code")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("saturation_aggregate", sql.with_ctes(*r.LEXICAL_CTES, sql.bm25(), "\nsat AS (" +
                                             r.SATURATION_SELECT.format(source="bm25") + ")", select="""
SELECT count(*) AS questions, round(avg(at_maximum), 6) AS mean_ties,
       round(avg(near_maximum), 6) AS mean_near_maximum, round(avg(top_spread), 6) AS mean_spread
FROM sat"""))
def saturation_aggregate(t):
    """Mean ties, near-maximum rows and spread of a lexical scorer over all questions."""
    per_question = r.lexical.saturation(r.bm25_for(t), "lexical",
                                        t.documents.select(F.count(F.lit(1))))
    return per_question.agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg("at_maximum"), 6).alias("mean_ties"),
        F.round(F.avg("near_maximum"), 6).alias("mean_near_maximum"),
        F.round(F.avg("top_spread"), 6).alias("mean_spread"))


@query("decision_status", """
SELECT event_id, status FROM (
  SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'resolved' END AS status FROM events
  UNION ALL SELECT event_id, CASE WHEN event_type IN ('view', 'click') OR value < 3 THEN 'pending' END FROM events
  UNION ALL SELECT event_id, CASE WHEN event_type = 'error' THEN 'replacement' END FROM events
  UNION ALL SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'error') OR value < 3 THEN 'blocker' END
  FROM events) WHERE status IS NOT NULL""")
def decision_status(t):
    """Cases under each decision status, one row per case and status it has."""
    kind, small = F.col("event_type"), F.col("value") < 3
    pending = kind.isin("view", "click") | small
    labels = F.array_compact(F.array(
        F.when(kind == "purchase", "resolved"), F.when(pending, "pending"),
        F.when(kind == "error", "replacement"), F.when(pending | (kind == "error"), "blocker")))
    return t.events.select("event_id", F.explode(labels).alias("status"))
