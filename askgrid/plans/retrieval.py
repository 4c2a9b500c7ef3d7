"""Retrieval and ranking over the document corpus.

Questions are the ``benchmark`` texts, the corpus is ``documents``; vectors of
both come from ``embeddings`` by id. Relationships between members come from
``lineitem`` (part to supplier), captions from the user turns of
``conversations``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.functions import text as tx
from askgrid.operators import candidates as cand
from askgrid.operators import dense, graph, lexical
from askgrid.operators.bounded import broadcast_if_small, cut, spread
from askgrid.plans import retrieval_sql as sql
from askgrid.plans.registry import query


def all_questions(t):
    return t.benchmark.select(F.col("item_id").alias("question_id"), "text")


def questions_with_vectors(t):
    return t.benchmark.join(t.embeddings, F.col("vec_id") == F.col("item_id")).select(
        F.col("item_id").alias("question_id"), "text", F.col("embedding").alias("vector"))


def corpus(t):
    return t.documents.select("doc_id").join(
        t.embeddings, F.col("vec_id") == F.col("doc_id")).select(
        F.col("doc_id").alias("id"), F.col("embedding").alias("vector"))


def records(t):
    lines = F.split("text", "\n")
    return spread(t.documents, "doc_id").select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("schema_text"),
        F.get(lines, F.lit(0)).alias("title"),
        F.slice(lines, F.lit(2), F.size(lines)).alias("columns"))


def alias_terms(t):
    """(id, tokens): distinct caption terms per document.

    The set per document is bounded by the vocabulary, not by the rows.
    """
    captions = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("id"), "text")
    return (captions.select("id", F.explode(tx.identifier_tokens(F.col("text"))).alias("term"))
            .groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("tokens")))


def caption_lines(t):
    """(id, role, line): every line of every turn is a caption."""
    return t.conversations.select(F.col("conv_id").alias("id"), "role",
                                  F.explode(F.split("text", "\n")).alias("line"))


def relations(t, indexed, seeds):
    """Outgoing relations of the seeds."""
    links = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.adjacency(graph.touching(links, seeds, "src"), indexed)


def reverse_relations(t, indexed, seeds):
    """Relations that arrive at the seeds, turned round."""
    links = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    arriving = graph.adjacency(graph.touching(links, seeds, "dst"), indexed)
    return arriving.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def hybrid_parts(t, scores):
    """Top lists and pair scorer for one lexical source."""
    asked, vectors = questions_with_vectors(t), corpus(t)
    top = partial(dense.hybrid_top, asked, vectors, scores)
    pairs = partial(dense.score_pairs, questions=asked, corpus=vectors, lexical=scores)
    return top, pairs


def lexical_for(t, extra=None):
    return lexical.lexical_scores(all_questions(t), records(t), extra)


def lexical_rows_for(t, extra=None):
    """The lexical scores, one row per document, for the plans that read them more than once."""
    return cut(lexical.lexical_rows(all_questions(t), records(t), extra))


def bm25_for(t, extra=None):
    """BM25 scores, one row per document."""
    return lexical.bm25_rows(all_questions(t), lexical.flattened_tokens(records(t), extra))


def expanded(t, scores, k=fixed.FINAL_DEPTH):
    top, pairs = hybrid_parts(t, scores)
    seeds = cut(top(fixed.SEED_COUNT))
    return graph.expand(seeds, relations(t, corpus(t), seeds), pairs, k)


HYBRID_COLUMNS = ("question_id", "id", "dense", "lexical", "score", "rank")
GRAPH_COLUMNS = ("question_id", "id", "score", "graph_signal", "bonus", "final_score", "is_seed",
                 "source_count", "best_rank", "best_source", "rank")


def hybrid_list(t, scores):
    return dense.hybrid_top(questions_with_vectors(t), corpus(t), scores,
                            fixed.FINAL_DEPTH).select(*HYBRID_COLUMNS)


HYBRID_SELECT = ("SELECT question_id, id, dense, lexical, score, CAST(rank AS INTEGER) AS rank "
                 "FROM hybrid WHERE rank <= 10")
GRAPH_SELECT = ("SELECT question_id, id, score, graph_signal, bonus, final_score, is_seed, "
                "source_count, best_rank, best_source, CAST(rank AS INTEGER) AS rank "
                "FROM graph WHERE rank <= 10")
LEXICAL_CTES = (sql.QUESTION_TERMS, sql.FIELDS, sql.DOC_TOKENS)


@query("question_token_bags", sql.with_ctes(sql.QUESTION_TERMS, select="""
SELECT question_id, term, query_frequency FROM q_terms"""))
def question_token_bags(t):
    """Normalised question tokens with their frequency."""
    return lexical.question_terms(all_questions(t))


@query("dense_topk", sql.with_ctes(sql.DENSE, select="""
SELECT question_id, id, cosine, dense, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, id DESC) AS rank
  FROM dense) WHERE rank <= 10"""))
def dense_topk(t):
    """Exact inner-product Top-10 of every question."""
    return dense.dense_top(questions_with_vectors(t), corpus(t), fixed.FINAL_DEPTH).select(
        "question_id", "id", "cosine", "dense", "rank")


@query("lexical_score", sql.with_ctes(*LEXICAL_CTES, sql.lexical(), select="""
SELECT question_id, id, lexical FROM lexical"""))
def lexical_score(t):
    """Table-heavy identifier score with column saturation, every positive pair."""
    return lexical_for(t)


@query("bm25_topk", sql.with_ctes(*LEXICAL_CTES, sql.bm25(), select="""
SELECT question_id, id, bm25_raw, lexical AS bm25, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, id DESC) AS rank
  FROM bm25) WHERE rank <= 10"""))
def bm25_topk(t):
    """BM25 Top-10 with raw and question-normalised scores."""
    w = Window.partitionBy("question_id").orderBy(F.desc("lexical"), F.desc("id"))
    return lexical.best_rows(bm25_for(t), 10).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(
        "question_id", "id", "bm25_raw", F.col("lexical").alias("bm25"), "rank")


@query("bm25_terms", sql.with_ctes(*LEXICAL_CTES, sql.bm25(), select="""
SELECT question_id, id, term, query_frequency, tf, df, round(idf, 6) AS idf,
       round(contribution, 6) AS contribution FROM bm25_parts"""))
def bm25_terms(t):
    """Explanation: each matched term with its frequencies, idf and contribution."""
    parts = lexical.bm25_contributions(all_questions(t), lexical.flattened_tokens(records(t)))
    return parts.where("contribution > 0").select(
        "question_id", "id", "term", "query_frequency", "tf", "df",
        F.round("idf", 6).alias("idf"), F.round("contribution", 6).alias("contribution"))


SATURATION_SELECT = """
SELECT question_id, maximum, count(*) FILTER (abs(lexical - maximum) <= 1e-12) AS at_maximum,
  count(*) FILTER (lexical >= 0.95::DOUBLE * maximum - 1e-12) AS near_maximum,
  round(maximum - CASE WHEN count(*) < least(20, (SELECT count(*) FROM documents)) THEN 0
        ELSE min(lexical) FILTER (n <= 20) END, 9) AS top_spread
FROM (SELECT *, max(lexical) OVER (PARTITION BY question_id) AS maximum,
             row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, id) AS n
      FROM {source}) GROUP BY question_id, maximum"""


@query("lexical_saturation", sql.with_ctes(*LEXICAL_CTES, sql.lexical(),
                                           select=SATURATION_SELECT.format(source="lexical")))
def lexical_saturation(t):
    return lexical.saturation(lexical_rows_for(t), "lexical", t.documents.select(F.count(F.lit(1))))


@query("bm25_saturation", sql.with_ctes(*LEXICAL_CTES, sql.bm25(),
                                        select=SATURATION_SELECT.format(source="bm25")))
def bm25_saturation(t):
    return lexical.saturation(bm25_for(t), "lexical", t.documents.select(F.count(F.lit(1))))


@query("hybrid_rank", sql.with_ctes(*LEXICAL_CTES, sql.lexical(), sql.DENSE, sql.hybrid(),
                                    select=HYBRID_SELECT))
def hybrid_rank(t):
    """0.70 dense + 0.30 lexical, Top-10."""
    return hybrid_list(t, lexical_rows_for(t))


@query("bm25_hybrid", sql.with_ctes(*LEXICAL_CTES, sql.bm25(), sql.DENSE, sql.hybrid("bm25"),
                                    select=HYBRID_SELECT))
def bm25_hybrid(t):
    return hybrid_list(t, bm25_for(t))


@query("alias_hybrid", sql.with_ctes(*LEXICAL_CTES, sql.ALIASES, sql.lexical("enriched_tokens"),
                                     sql.DENSE, sql.hybrid(), select=HYBRID_SELECT))
def alias_hybrid(t):
    """Hybrid with titles enriched by caption terms."""
    return hybrid_list(t, lexical_rows_for(t, alias_terms(t)))


@query("alias_bm25_hybrid", sql.with_ctes(*LEXICAL_CTES, sql.ALIASES, sql.bm25("enriched_bag"),
                                          sql.DENSE, sql.hybrid("bm25"), select=HYBRID_SELECT))
def alias_bm25_hybrid(t):
    return hybrid_list(t, bm25_for(t, alias_terms(t)))


def graph_sql(*lexical_parts: str, source: str) -> str:
    return sql.with_ctes(*LEXICAL_CTES, *lexical_parts, sql.DENSE, sql.hybrid(source), sql.EDGES,
                         sql.reached(), sql.expansion(), select=GRAPH_SELECT)


@query("graph_expand", graph_sql(sql.lexical(), source="lexical"))
def graph_expand(t):
    """Hybrid seeds, one hop over outgoing relations, rank-discounted bonus."""
    return expanded(t, lexical_rows_for(t)).select(*GRAPH_COLUMNS)


@query("bm25_graph", graph_sql(sql.bm25(), source="bm25"))
def bm25_graph(t):
    return expanded(t, bm25_for(t)).select(*GRAPH_COLUMNS)


@query("alias_graph", graph_sql(sql.ALIASES, sql.lexical("enriched_tokens"), source="lexical"))
def alias_graph(t):
    return expanded(t, lexical_rows_for(t, alias_terms(t))).select(*GRAPH_COLUMNS)


@query("alias_bm25_graph", graph_sql(sql.ALIASES, sql.bm25("enriched_bag"), source="bm25"))
def alias_bm25_graph(t):
    return expanded(t, bm25_for(t, alias_terms(t))).select(*GRAPH_COLUMNS)


@query("dense_graph", sql.with_ctes(sql.DENSE, sql.DENSE_AS_HYBRID, sql.EDGES, sql.reached(),
                                    sql.expansion(), select=GRAPH_SELECT))
def dense_graph(t):
    """Graph expansion with the dense score in place of the hybrid one."""
    asked, vectors = questions_with_vectors(t), corpus(t)
    seeds = cut(dense.dense_top(asked, vectors, fixed.SEED_COUNT)
                .withColumn("score", F.col("dense")))
    pairs = partial(dense.score_pairs, questions=asked, corpus=vectors, lexical=None)
    return graph.expand(seeds, relations(t, vectors, seeds), pairs, fixed.FINAL_DEPTH).select(
        *GRAPH_COLUMNS)


AUGMENTED = """
reverse_edges AS (SELECT dst AS src, src AS dst FROM edges),
additional AS (SELECT * FROM reverse_edges EXCEPT SELECT src, dst FROM edges)""", sql.reached(
    "additional", "additional_reached"), """
capped AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.question_id, r.source
                                 ORDER BY h.score DESC, r.id DESC) AS n,
         count(*) OVER (PARTITION BY r.question_id, r.source) AS considered
  FROM additional_reached r JOIN hybrid h ON h.question_id = r.question_id AND h.id = r.id),
all_reached AS (
  SELECT question_id, id, source, seed_rank, signal FROM direct
  UNION ALL SELECT question_id, id, source, seed_rank, signal FROM capped WHERE n <= 10)"""


def augmented_parts(t):
    top, pairs = hybrid_parts(t, lexical_rows_for(t))
    seeds = cut(top(fixed.SEED_COUNT))
    outgoing = relations(t, corpus(t), seeds)
    extra = reverse_relations(t, corpus(t), seeds).join(outgoing, ["src", "dst"], "left_anti")
    return seeds, outgoing, graph.additional_edges(seeds, extra, pairs), pairs


@query("augmented_graph", sql.with_ctes(
    *LEXICAL_CTES, sql.lexical(), sql.DENSE, sql.hybrid(), sql.EDGES, sql.reached(), *AUGMENTED,
    sql.expansion("all_reached"), select=GRAPH_SELECT))
def augmented_graph(t):
    """Outgoing relations plus at most ten reverse neighbours per seed."""
    seeds, outgoing, extra, pairs = augmented_parts(t)
    direct = graph.seed_edges(seeds, outgoing)
    reached = direct.unionByName(extra.select(*direct.columns))
    return graph.rank_reached(seeds, reached, pairs, fixed.FINAL_DEPTH).select(*GRAPH_COLUMNS)


@query("augmented_cap_diagnostics", sql.with_ctes(
    *LEXICAL_CTES, sql.lexical(), sql.DENSE, sql.hybrid(), sql.EDGES, sql.reached(), *AUGMENTED,
    select="""
SELECT question_id, source, min(seed_rank) AS seed_rank, max(considered) AS considered,
       count(*) FILTER (n <= 10) AS admitted,
       max(considered) - count(*) FILTER (n <= 10) AS excluded
FROM capped GROUP BY ALL"""))
def augmented_cap_diagnostics(t):
    """Per seed: additional neighbours considered, admitted and cut by the cap."""
    extra = augmented_parts(t)[2]
    return extra.groupBy("question_id", "source").agg(
        F.min("seed_rank").alias("seed_rank"), F.max("considered").alias("considered"),
        F.count(F.lit(1)).alias("admitted"),
        (F.max("considered") - F.count(F.lit(1))).alias("excluded"))


@query("alias_evidence", sql.with_ctes(*LEXICAL_CTES, sql.ALIASES, select=f"""
SELECT question_id, t.id, string_agg(DISTINCT t.term, ',' ORDER BY t.term) AS new_terms
FROM alias_tokens t JOIN q_terms USING (term)
WHERE NOT EXISTS (SELECT 1 FROM doc_tokens d WHERE d.id = t.id AND d.term = t.term)
GROUP BY ALL"""))
def alias_evidence(t):
    """Question terms a caption adds that the document itself does not have."""
    own = lexical.flattened_tokens(records(t)).select("id", F.col("tokens").alias("own"))
    new = alias_terms(t).join(own, "id").select("id", F.explode(
        F.array_except("tokens", "own")).alias("term"))
    return new.join(lexical.question_terms(all_questions(t)), "term").groupBy(
        "question_id", "id").agg(
        F.array_join(F.array_sort(F.collect_set("term")), ",").alias("new_terms"))


ALIAS_TUPLES = f"""
tuples AS (
  SELECT id, role, list_filter(list_transform(list_transform(list_filter({sql.words('value')},
      lambda w: w <> ''), lambda w: {sql.singular('w')}), lambda w: {sql.spelled('w')}),
      lambda w: w NOT IN ({sql.quoted(fixed.STRUCTURAL_TOKENS)})) AS tokens
  FROM ({{source}}))"""
TITLE_TUPLES = ALIAS_TUPLES.replace("tuples AS", "titles AS", 1).replace("id, role,", "id,").replace(
    "{source}", "SELECT doc_id AS id, string_split(text, chr(10))[1] AS value FROM documents")
ALIAS_TUPLES = ALIAS_TUPLES.replace(
    "{source}", "SELECT conv_id AS id, role, unnest(string_split(text, chr(10))) AS value FROM conversations")


@query("alias_statistics", sql.with_ctes(ALIAS_TUPLES, TITLE_TUPLES, """
effective AS (
  SELECT a.id, count(DISTINCT a.tokens) AS n FROM tuples a JOIN titles d ON d.id = a.id
  WHERE a.role = 'user' AND len(list_filter(a.tokens, lambda w: NOT list_contains(d.tokens, w))) > 0
  GROUP BY a.id)""", select="""
SELECT count(*) AS documents, count(*) FILTER (coalesce(n, 0) > 0) AS gaining,
  count(*) FILTER (coalesce(n, 0) = 0) AS without, max(coalesce(n, 0)) AS maximum,
  CAST(sum(coalesce(n, 0)) AS DOUBLE) / count(*) AS average
FROM titles LEFT JOIN effective USING (id)"""))
def alias_statistics(t):
    """Effective captions per document: distinct ordered token tuples that add a new title term."""
    captions = caption_lines(t).where("role = 'user'").select(
        "id", tx.identifier_tokens(F.col("line")).alias("tokens"))
    titles = records(t).select("id", tx.identifier_tokens(F.col("title")).alias("title"))
    effective = (captions.where(F.size("tokens") > 0).distinct().join(titles, "id")
                 .where(F.size(F.array_except("tokens", "title")) > 0)
                 .groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    joined = titles.select("id").join(effective, "id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    return joined.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") > 0).alias("gaining"),
        F.count_if(F.col("n") == 0).alias("without"), F.max("n").alias("maximum"),
        (F.sum("n").cast("double") / F.count(F.lit(1))).alias("average"))


CHUNK_SQL = """
chunk_dense AS (
  SELECT question_id, vec_id // 4 AS id, vec_id AS part_id,
         round(list_dot_product(CAST(embedding AS DOUBLE[]), qv), 9) AS cosine
  FROM q, embeddings),
pooled AS (
  SELECT question_id, id, cosine, part_id,
         round(least(1.0, greatest(0.0, (cosine + 1.0) / 2.0)), 12) AS dense
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id, id ORDER BY cosine DESC, part_id) AS n
        FROM chunk_dense) WHERE n = 1)"""


def chunks(t):
    """Vectors as chunks: four consecutive ones belong to one document."""
    return t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("id"),
                               F.col("vec_id").alias("part_id"), F.col("embedding").alias("vector"))


@query("chunk_max_pool", sql.with_ctes(sql.DENSE, CHUNK_SQL, select="""
SELECT question_id, id, part_id AS winning_chunk, cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, id DESC) AS rank
  FROM pooled) WHERE rank <= 10"""))
def chunk_max_pool(t):
    """A document scores as its best chunk, and keeps that chunk."""
    return dense.pooled_top(questions_with_vectors(t), chunks(t), fixed.FINAL_DEPTH).select(
        "question_id", "id", F.col("part_id").alias("winning_chunk"), "cosine", "rank")


CHUNK_CORPUS = """
c AS (SELECT DISTINCT vec_id // 4 AS id FROM embeddings)"""
CHUNK_CTES = (*LEXICAL_CTES, sql.lexical(), sql.DENSE.replace("c AS", "unused AS").replace(
    "dense AS", "whole AS").replace("FROM q, c", "FROM q, unused"), CHUNK_SQL, CHUNK_CORPUS,
    "\ndense AS (SELECT question_id, id, cosine, dense FROM pooled)", sql.hybrid())


@query("chunked_hybrid", sql.with_ctes(*CHUNK_CTES, select=HYBRID_SELECT))
def chunked_hybrid(t):
    """Best-chunk dense score with the lexical score of the document."""
    return dense.pooled_hybrid_top(questions_with_vectors(t), chunks(t), lexical_rows_for(t),
                                   fixed.FINAL_DEPTH).select(*HYBRID_COLUMNS)


@query("chunked_graph", sql.with_ctes(*CHUNK_CTES, sql.EDGES, sql.reached(), sql.expansion(),
                                      select=GRAPH_SELECT))
def chunked_graph(t):
    asked, parts, scores = questions_with_vectors(t), chunks(t), lexical_rows_for(t)
    seeds = cut(dense.pooled_hybrid_top(asked, parts, scores, fixed.SEED_COUNT))
    pairs = partial(dense.score_pooled_pairs, questions=asked, chunks=parts, lexical=scores)
    edges = relations(t, parts.select("id").distinct(), seeds)
    return graph.expand(seeds, edges, pairs, fixed.FINAL_DEPTH).select(*GRAPH_COLUMNS)


@query("alias_records", "WITH" + ALIAS_TUPLES + """
SELECT id, array_to_string(tokens, ' ') AS token_key, count(*) AS occurrences,
       string_agg(DISTINCT role, ',' ORDER BY role) AS source_categories
FROM tuples WHERE len(tokens) > 0 GROUP BY ALL""")
def alias_records(t):
    """Captions deduplicated by their ordered token tuple, source categories merged."""
    return (caption_lines(t).select("id", "role", F.array_join(
                tx.identifier_tokens(F.col("line")), " ").alias("token_key"))
            .where("token_key <> ''").groupBy("id", "token_key").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("source_categories")))


@query("shared_query_two_indexes", sql.with_ctes(sql.DENSE, """
second AS (SELECT question_id, supplier, id, round(list_dot_product(v, qv), 9) AS cosine
  FROM q, (SELECT doc_id AS id, CAST(embedding AS DOUBLE[]) AS v, 1 AS supplier FROM documents
           JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id WHERE quality = 1))""",
    select="""
SELECT question_id, 'all' AS index_name, id, cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, id DESC) AS rank
  FROM dense) WHERE rank <= 10
UNION ALL
SELECT question_id, 'quality', id, cosine, CAST(rank AS INTEGER) FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, id DESC) AS rank
  FROM second) WHERE rank <= 10"""))
def shared_query_two_indexes(t):
    """One set of question vectors searched in two indexes."""
    asked, whole = questions_with_vectors(t), corpus(t)
    good = whole.join(t.labels.where("quality = 1").select(F.col("doc_id").alias("id")), "id",
                      "left_semi")
    found = [dense.dense_top(asked, index, fixed.FINAL_DEPTH).select(
        "question_id", F.lit(name).alias("index_name"), "id", "cosine", "rank")
        for name, index in (("all", whole), ("quality", good))]
    return found[0].unionByName(found[1])


CANDIDATE_CTES = (*LEXICAL_CTES, sql.lexical(), sql.DENSE, sql.hybrid(), sql.EDGES, sql.reached(),
                  sql.expansion(), """
dense_rank AS (SELECT *, row_number() OVER (
  PARTITION BY question_id ORDER BY cosine DESC, id DESC) AS r FROM dense),
candidates AS (
  SELECT question_id, id, string_agg(source, ',' ORDER BY source) AS sources FROM (
    SELECT question_id, id, 'dense' AS source FROM dense_rank WHERE r <= 50
    UNION ALL SELECT question_id, id, 'graph' FROM graph WHERE rank <= 50) GROUP BY ALL)""")


def candidates_for(t):
    depth = fixed.CANDIDATE_DEPTH
    return cand.union_candidates({
        "dense": dense.dense_top(questions_with_vectors(t), corpus(t), depth),
        "graph": expanded(t, lexical_rows_for(t), depth)})


@query("candidate_union", sql.with_ctes(*CANDIDATE_CTES, select="""
SELECT question_id, id, sources FROM candidates"""))
def candidate_union(t):
    """Dense Top-50 and graph Top-50, merged by id."""
    return candidates_for(t)


RERANK_CTES = f"""
asked AS (SELECT question_id, sum({sql.weight('term')}) AS total FROM q_terms GROUP BY question_id),
shared AS (
  SELECT c.question_id, c.id, sum({sql.weight('d.term')}) AS s FROM candidates c
  JOIN q_terms qt ON qt.question_id = c.question_id
  JOIN (SELECT DISTINCT id, term FROM doc_tokens) d ON d.id = c.id AND d.term = qt.term
  GROUP BY ALL),
reranked AS (
  SELECT question_id, id, sources, pair_score,
         row_number() OVER (PARTITION BY question_id ORDER BY pair_score DESC, id) AS rank
  FROM (SELECT c.question_id, c.id, c.sources, round(coalesce(s / total, 0), 9) AS pair_score
        FROM candidates c LEFT JOIN asked USING (question_id)
        LEFT JOIN shared USING (question_id, id)))"""


def reranked_for(t):
    """Only the documents of some candidate are tokenised."""
    chosen = cut(candidates_for(t))
    wanted = records(t).join(broadcast_if_small(chosen.select("id").distinct()), "id", "left_semi")
    return cand.rerank(cand.score_candidates(
        chosen, all_questions(t), lexical.flattened_tokens(wanted)))


@query("union_rerank", sql.with_ctes(*CANDIDATE_CTES, RERANK_CTES, select="""
SELECT question_id, id, sources, pair_score, CAST(rank AS INTEGER) AS rank FROM reranked
WHERE rank <= 10"""))
def union_rerank(t):
    """Pair scores on the candidates only, then Top-10 with the ascending tie rule."""
    return reranked_for(t).select("question_id", "id", "sources", "pair_score", "rank")


@query("pair_budgets", sql.with_ctes(sql.DENSE, r"""
top AS (SELECT question_id, id FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, id DESC) AS rank FROM dense)
  WHERE rank <= 10),
sized AS (SELECT question_id, id, len(string_split(trim(regexp_replace(b.text, '\s+', ' ', 'g')), ' '))
    + len(string_split(trim(regexp_replace(d.text, '\s+', ' ', 'g')), ' ')) AS n
  FROM top JOIN benchmark b ON item_id = question_id JOIN documents d ON doc_id = id)""", select=f"""
SELECT question_id, id, CAST(n AS INTEGER) AS pair_tokens, n > {fixed.PAIR_TOKEN_BUDGET} AS over_budget
FROM sized"""))
def pair_budgets(t):
    """Length of each question with its best ten documents, against the pair budget."""
    top = cut(dense_topk(t).select("question_id", "id"))
    asked = all_questions(t).withColumnRenamed("text", "question")
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    size = cand.pair_tokens("question", "text")
    return (texts.join(broadcast_if_small(top), "id").join(broadcast_if_small(asked), "question_id")
            .select("question_id", "id", size.alias("pair_tokens"),
                    (size > fixed.PAIR_TOKEN_BUDGET).alias("over_budget")))
