"""The pipeline on small tables, stage by stage against brute force."""

import corpus_pipeline
import pytest
from fixtures import documents
from test_decontaminate import brute as hits_of
from test_minhash import brute as components_of

from askgrid.llm import quality, toxicity
from askgrid.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = Tables(spark, SF).documents, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return dict(out)


def test_columns_and_names(spark, stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "toxicity", "near duplicates", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == Tables(spark, SF).documents.columns


def test_each_stage_acts_on_what_is_left(spark, stages):
    tables = Tables(spark, SF)
    machine = quality.train(tables.documents, tables.labels)
    chain = toxicity.train(tables.documents, tables.labels)
    left = {r.doc_id: r.text for r in tables.documents.collect()}
    for name, keep in (
            ("quality", lambda docs: {i for i, t in docs.items() if machine.score(t.encode()) >= 0.5}),
            ("toxicity", lambda docs: {i for i, t in docs.items() if chain.predict([t.encode()])[0, -1] < 0.5}),
            ("near duplicates", lambda docs: {i for i, (_, root) in components_of(list(docs.items()), 80).items() if i == root}),
            ("decontamination", lambda docs: {i for i, t in docs.items() if not contaminated(t)})):
        expected = keep(left)
        found = {r.doc_id: r.text for r in stages[name].collect()}
        assert set(found) == expected and len(found) == stages[name].count()
        left = {i: left[i] for i in expected}
    pieces = stages["packing"].collect()
    assert {r.doc_id for r in pieces} == set(left)
    totals = {}
    for row in pieces:
        totals[row.doc_id] = totals.get(row.doc_id, 0) + row.length
        assert totals[row.doc_id] <= row.doc_tokens
    assert all(totals[r.doc_id] == r.doc_tokens for r in pieces)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces))


_ITEMS = []


@pytest.fixture(scope="module", autouse=True)
def items(spark):
    _ITEMS[:] = [tuple(r) for r in Tables(spark, SF).benchmark.collect()]


def contaminated(text):
    n, hit, _ = hits_of(text, _ITEMS)
    return hit > 0 and 20 * hit >= n


def test_odd_documents_pass_through(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.columns == documents(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
