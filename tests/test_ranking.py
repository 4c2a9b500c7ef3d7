import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from askgrid.operators import candidates as cand
from askgrid.operators import dense, graph


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    def unit(n):
        m = rng.normal(size=(n, 8))
        return m / np.linalg.norm(m, axis=1, keepdims=True)
    q, c = unit(3), unit(40)
    questions = spark.createDataFrame([(i, q[i].tolist()) for i in range(3)],
                                      "question_id bigint, vector array<double>")
    corpus = spark.createDataFrame([(i, c[i].tolist()) for i in range(40)],
                                   "id bigint, vector array<double>").repartition(4)
    return q, c, questions, corpus


def test_dense_top_equals_brute_force(vectors):
    q, c, questions, corpus = vectors
    got = {(r.question_id, r["rank"]): r.id for r in dense.dense_top(questions, corpus, 7).collect()}
    for i in range(3):
        order = np.argsort(-(c @ q[i]))[:7]
        assert [got[i, k + 1] for k in range(7)] == order.tolist()


def test_question_blocks_cover_large_question_sets(vectors, monkeypatch):
    _, _, questions, corpus = vectors
    whole = sorted(dense.dense_top(questions, corpus, 5).collect())
    monkeypatch.setattr(dense, "MAX_QUESTIONS_IN_TASK", 2)
    assert sorted(dense.dense_top(questions, corpus, 5).collect()) == whole


def test_hybrid_lets_every_document_compete(spark, vectors):
    q, c, questions, corpus = vectors
    scores = spark.createDataFrame([(0, 11, 1.0), (1, 5, 0.4)],
                                   "question_id bigint, id bigint, lexical double")
    got = {(r.question_id, r.id): r.score for r in dense.hybrid_top(questions, corpus, scores, 40).collect()}
    assert len(got) == 120
    for (question, member), score in got.items():
        lexical = {(0, 11): 1.0, (1, 5): 0.4}.get((question, member), 0.0)
        expected = 0.7 * min(1, max(0, (float(c[member] @ q[question]) + 1) / 2)) + 0.3 * lexical
        assert abs(score - expected) < 1e-8
    pairs = spark.createDataFrame([(0, 11), (2, 7)], "question_id bigint, id bigint")
    for row in dense.score_pairs(pairs, questions, corpus, scores).collect():
        assert abs(row.score - got[row.question_id, row.id]) < 1e-9


def test_pooled_keeps_the_best_chunk(spark, vectors):
    q, c, questions, _ = vectors
    chunks = spark.createDataFrame([(i // 5, i, c[i].tolist()) for i in range(40)],
                                   "id bigint, part_id bigint, vector array<double>").repartition(3)
    for row in dense.pooled_top(questions, chunks, 8).collect():
        scores = [float(c[i] @ q[row.question_id]) for i in range(row.id * 5, row.id * 5 + 5)]
        assert row.part_id == row.id * 5 + int(np.argmax(scores))
        assert abs(row.cosine - max(scores)) < 1e-8


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def test_adjacency_is_distinct_indexed_and_without_self_edges(spark):
    indexed = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    edges = graph.adjacency(links(spark, [(1, 2), (1, 2), (1, 1), (1, 9), (9, 1), (3, 1)]), indexed)
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 2), (3, 1)]


def test_expansion_is_one_hop_with_discounted_bonus(spark):
    scores = {1: 0.9, 2: 0.8, 3: 0.5, 4: 0.4, 5: 0.3}
    seeds = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2)],
                                  "question_id bigint, id bigint, score double, rank int")
    table = spark.createDataFrame([(i, s) for i, s in scores.items()], "id bigint, score double")
    edges = links(spark, [(1, 3), (2, 3), (3, 4), (2, 1)])
    out = graph.expand(seeds, edges, lambda pairs: pairs.join(table, "id"), 10).collect()
    by = {r.id: r for r in out}
    assert set(by) == {1, 2, 3}
    assert by[3].graph_signal == 0.9 and by[3].best_source == 1 and by[3].source_count == 2
    assert abs(by[3].final_score - (0.5 + 0.2 * 0.9)) < 1e-9
    assert abs(by[1].final_score - (0.9 + 0.2 * 0.8 / math.log2(3))) < 1e-9
    assert by[2].graph_signal == 0.0 and by[2].is_seed
    assert [r.id for r in sorted(out, key=lambda r: r["rank"])] == [1, 2, 3]


def test_equal_signals_prefer_lower_rank_then_lower_source(spark):
    reached = spark.createDataFrame([(0, 7, 5, 2, 0.5), (0, 7, 4, 2, 0.5), (0, 7, 9, 1, 0.5)],
                                    "question_id bigint, id bigint, source bigint, seed_rank int, signal double")
    row = graph.best_signals(reached).first()
    assert (row.best_rank, row.best_source, row.source_count) == (1, 9, 3)


def test_additional_neighbours_are_capped_per_seed(spark):
    seeds = spark.createDataFrame([(0, 1, 0.9, 1)], "question_id bigint, id bigint, score double, rank int")
    extra = links(spark, [(1, i) for i in range(10, 30)])
    score = lambda pairs: pairs.withColumn("score", F.col("id") / 100.0)
    out = graph.additional_edges(seeds, extra, score, cap=10).collect()
    assert sorted(r.id for r in out) == list(range(20, 30))
    assert {r.considered for r in out} == {20}


def test_union_and_rerank_tie_rules(spark):
    frame = lambda ids: spark.createDataFrame([(0, i) for i in ids], "question_id bigint, id bigint")
    union = {r.id: r.sources for r in cand.union_candidates({"graph": frame([1, 2]), "dense": frame([2, 3])}).collect()}
    assert union == {1: "graph", 2: "dense,graph", 3: "dense"}
    scored = spark.createDataFrame([(0, 5, 0.5), (0, 3, 0.5), (0, 9, 0.7)],
                                   "question_id bigint, id bigint, pair_score double")
    assert [r.id for r in cand.rerank(scored, 2).orderBy("rank").collect()] == [9, 3]
    with pytest.raises(Exception, match="not finite"):
        cand.rerank(spark.createDataFrame([(0, 1, float("nan"))],
                                          "question_id bigint, id bigint, pair_score double")).collect()


def test_pair_budget_is_enforced(spark):
    pairs = spark.createDataFrame([("a b", "c d e")], "q string, d string")
    assert cand.check_pair_budget(pairs, "q", "d", 5).first().pair_tokens == 5
    with pytest.raises(Exception, match="budget"):
        cand.check_pair_budget(pairs, "q", "d", 4).collect()


def test_summary_takes_identity_and_columns(spark):
    text = "Identity: a.b\nForms: x\nColumns: c; d"
    got = spark.range(1).select(cand.summary(F.lit(text)).alias("s")).first().s
    assert got == "Identity: a.b · Columns: c; d"
