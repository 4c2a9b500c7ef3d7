"""Quality and toxicity: identities, held-out accuracy, odd rows."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, texts
from pyspark.sql import functions as F

from askgrid.llm import quality, toxicity
from askgrid.sources.tables import Tables

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def trained(spark):
    tables = Tables(spark, SF)
    return quality.train(tables.documents, tables.labels), toxicity.train(tables.documents, tables.labels)


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    labels = np.array(labels, bool)
    return (ranks[labels].sum() - labels.sum() * (labels.sum() + 1) / 2) / (labels.sum() * (~labels).sum())


def test_linear_time_score_equals_all_pairs(trained):
    machine = trained[0]
    for raw in (b"", b"Some words, some more words!!", ("ü | ### " * 30).encode()):
        at, x = machine.inputs(raw)
        pairs = sum(float(machine.factors[at[i]] @ machine.factors[at[j]]) * x[i] * x[j]
                    for i in range(len(at)) for j in range(i))
        margin = machine.bias + float(machine.weights[at] @ x) + pairs
        assert abs(machine.score(raw) - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-4


def test_held_out_rows_follow_the_checksum(spark):
    rows = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_held_out_accuracy(spark, trained):
    tables = Tables(spark, SF)
    docs = tables.documents.select("doc_id", "text").join(tables.labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    rows = toxicity.with_toxicity(quality.with_quality(docs, trained[0]), trained[1]).collect()
    assert len(rows) > 1000
    good = [r.quality for r in rows]
    assert auc(np.array([r.score for r in rows]), good) > 0.9
    assert np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.95
    assert auc(np.array([r.p_toxic for r in rows]), [r.toxic for r in rows]) > 0.75
    assert np.mean([(r.p_toxic >= 0.5) == r.toxic for r in rows]) > 0.92


def test_toxic_documents_of_each_language_are_found(spark, trained):
    tables = Tables(spark, SF)
    docs = tables.documents.select("doc_id", "text", "lang").join(tables.labels, "doc_id").where(
        quality.held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    found, every, wrong = {}, {}, {}
    for r in toxicity.with_toxicity(docs, trained[1]).collect():
        for counts, hit in ((found, r.toxic and r.p_toxic >= 0.5), (every, r.toxic),
                            (wrong, not r.toxic and r.p_toxic >= 0.5)):
            counts[r.lang] = counts.get(r.lang, 0) + bool(hit)
    print("found", found, "of", every, "wrong", wrong)
    assert set(every) == {"en", "de", "fr", "es"}
    assert all(found[lang] >= 0.8 * every[lang] and wrong[lang] <= 3 for lang in every)


def test_terms_are_the_same_in_training_and_scoring(spark):
    rows = documents(spark).select("text", toxicity.terms_column(F.col("text")).alias("terms")).collect()
    assert any(len(r.terms) > 20 for r in rows)
    for r in rows:
        assert sorted(r.terms) == sorted(toxicity.terms_of((r.text or "").encode()))


def test_number_of_terms_has_no_cap(spark):
    rows = [(i, int(i < 400), [f"t{i // 4:03d}", f"t{i // 4:03d}x", "all"]) for i in range(4000)]
    chosen = toxicity.choose_terms(spark.createDataFrame(rows, "doc_id long, label int, terms array<string>"))
    assert chosen == [([f"t{k:03d}", f"t{k:03d}x"], True) for k in range(100)]


def test_chain_passes_earlier_probabilities_on():
    rng = np.random.default_rng(2)
    presence = (rng.random((600, 4)) < 0.3).astype(float)
    first = (presence[:, 0] > 0).astype(int)
    second = first * (rng.random(600) < 0.9)
    chain = toxicity.fit_chain(presence, np.c_[first, second], np.arange(600) % 5, ["a", "b", "c", "d"], ("one", "two"))
    assert [len(w) for w in chain.weights] == [5, 6]
    found = chain.predict([b"a x", b"b", b""])
    assert found[0].min() > 0.6 and found[1:].max() < 0.4


def test_a_fold_is_predicted_without_its_own_terms(spark):
    """A term that only one fold knows tells later models nothing."""
    words = [[f"w{i % 10}"] + ["own"] * (i % 2) for i in range(400)]
    label, folds = np.arange(400) % 2, np.arange(400) % 10 // 2
    with_own = toxicity.inputs_of(words, label, [(["own"], True), (["w1"], False)])
    without = toxicity.inputs_of(words, label, [(["w1"], False)])
    assert with_own[0].shape == (400, 2) and with_own[1].sum(0).tolist() == [200, 0, 200]
    leaking = toxicity.fit_chain(*with_own, folds, ["own", "w1"])
    clean = toxicity.fit_chain(*with_own, folds, ["own", "w1"], of_fold={k: without for k in range(5)})
    assert abs(leaking.weights[2][2]) > abs(clean.weights[2][2]) + 0.1


def test_inputs_are_shares_of_a_group():
    presence, targets = toxicity.inputs_of([["a", "b"], ["b"], [], ["z"]], np.array([1, 1, 0, 0]), [(["a", "b"], True)])
    assert (presence.rows.tolist(), presence.shares.tolist(), presence.shape) == ([0, 1], [1.0, 0.5], (4, 1))
    assert targets.tolist() == [[1, 0, 1], [1, 0, 1], [0, 0, 0], [0, 0, 0]]
    assert toxicity.inputs_of([["a"]], np.array([1]), [])[0].shape == (1, 0)


def test_training_words_take_little_memory():
    """A word is one object however many rows hold it; its entries are numbers, not Python rows."""
    column = pa.chunked_array([[["alpha", "beta"], ["beta"]], [None, [], ["beta"]]])
    words = toxicity.shared_words(column)
    assert words == [["alpha", "beta"], ["beta"], [], [], ["beta"]]
    assert words[0][1] is words[1][0] is words[4][0]
    words = [[f"w{k}" for k in range(100)]] * 2000
    tracemalloc.start()
    presence, _ = toxicity.inputs_of(words, np.arange(2000) % 2, [([f"w{k}"], False) for k in range(100)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(presence.rows) == 200_000 and most < 80 * 200_000


def test_odd_rows_and_columns(spark, trained):
    docs = documents(spark)
    scored = quality.with_quality(docs, trained[0]).collect()
    assert len(scored) == len(texts()) and all(0 < r.score < 1 for r in scored)
    kept = quality.drop_low_quality(docs, trained[0])
    assert kept.columns == docs.columns and kept.count() <= len(texts())
    toxic = docs.withColumn("p_toxic", F.lit("own"))
    kept = toxicity.drop_toxic(toxic, trained[1])
    assert kept.columns == toxic.columns and {r.p_toxic for r in kept.collect()} == {"own"}
    assert quality.with_quality(empty(spark), trained[0]).count() == 0
    assert toxicity.with_toxicity(empty(spark), trained[1]).count() == 0


def test_without_labels(spark):
    labels = spark.createDataFrame([(None, 1, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    machine = quality.train(documents(spark), labels)
    assert machine.score(b"any text") == 0.5
    chain = toxicity.train(documents(spark), labels)
    assert toxicity.with_toxicity(documents(spark), chain).count() == len(texts())
