from pyspark.sql import functions as F

from askgrid.functions import text as tx
from askgrid.operators import lexical
from askgrid.operators.metrics import evidence_words


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_identifier_tokens(spark):
    assert value(spark, tx.identifier_tokens(F.lit("tblSalesOrderQtyID"))) == [
        "sale", "order", "quantity"]
    assert value(spark, tx.identifier_tokens(F.lit("HTTPServerNo_Categories"))) == [
        "http", "server", "number", "category"]


def test_question_tokens_drop_stop_words(spark):
    assert value(spark, tx.question_tokens(F.lit("Show all the invoices for each customer"))) == [
        "invoice", "customer"]


def test_singular_rules(spark):
    words = ["series", "ties", "buses", "glass", "gas", "orders", "boxes"]
    got = value(spark, F.transform(F.array(*map(F.lit, words)), tx.singular))
    assert got == ["sery", "tie", "bus", "glass", "gas", "order", "boxe"]


def test_humanize(spark):
    assert value(spark, tx.humanize(F.lit("SalesInvoiceItem"))) == "Sales Invoice Item"


def test_shorten_adds_an_ellipsis(spark):
    assert value(spark, tx.shorten(F.lit("abcdefgh"), 5)) == "abcd…"
    assert value(spark, tx.shorten(F.lit("abc"), 5)) == "abc"


def records(spark, rows):
    return spark.createDataFrame(
        rows, "id bigint, schema_text string, title string, columns array<string>")


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "question_id bigint, text string")


def test_table_name_beats_generic_columns(spark):
    rows = records(spark, [(1, "s", "tblInvoice", ["Total"]),
                           (2, "s", "Other", ["InvoiceDate", "Name", "Code", "Date"]),
                           (3, "s", "tblId", ["ID"])])
    got = {r.id: r.lexical for r in lexical.lexical_scores(ask(spark, "invoice dates id"), rows).collect()}
    assert got[1] == 0.65
    assert abs(got[2] - 0.3 * (0.5 * 1.0 + 0.25 * 0.2)) < 1e-9
    assert 3 not in got


def test_extra_tokens_enrich_only_the_title(spark):
    rows = records(spark, [(1, "s", "Ledger", ["Total"]), (2, "s", "Ledger", ["Total"])])
    extra = spark.createDataFrame([(2, ["invoice"])], "id bigint, tokens array<string>")
    got = {r.id: r.lexical for r in lexical.lexical_scores(ask(spark, "invoice"), rows, extra).collect()}
    assert got == {2: 0.65}


def test_scoring_in_tasks_equals_scoring_by_join(spark, monkeypatch):
    import random
    rng = random.Random(2)
    words = ["order", "date", "name", "customer", "total", "code", "invoice", "type", "a1", "b2"]
    rows = records(spark, [(i, rng.choice(words), " ".join(rng.sample(words, 2)),
                            [" ".join(rng.sample(words, rng.randint(0, 4))) for _ in range(rng.randint(0, 9))])
                           for i in range(40)])
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, 4))) for q in range(6)],
                                  "question_id bigint, text string")
    extra = spark.createDataFrame([(3, ["b2", "order"]), (4, ["a1"])], "id bigint, tokens array<string>")
    quick = sorted(lexical.lexical_scores(asked, rows, extra).collect())
    monkeypatch.setattr(lexical, "MAX_TERMS_IN_TASK", 3)
    joined = sorted(lexical.lexical_scores(asked, rows, extra).collect())
    assert len(quick) > 100 and quick == joined


def test_bm25_matches_the_formula(spark):
    import math
    bags = spark.createDataFrame(
        [(1, ["a1", "b1", "a1"], 3), (2, ["b1"], 1), (3, [], 0)],
        "id bigint, tokens array<string>, length int")
    parts = lexical.bm25_contributions(ask(spark, "a1 a1 b1 zz"), bags)
    got = {(r.id, r.term): r.contribution for r in parts.collect()}
    mean = 4 / 3

    def part(count, tf, df, length):
        idf = math.log(1 + (3 - df + 0.5) / (df + 0.5))
        return count * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))

    assert set(got) == {(1, "a1"), (1, "b1"), (2, "b1")}
    assert abs(got[1, "a1"] - part(2, 2, 1, 3)) < 1e-12
    assert abs(got[2, "b1"] - part(1, 1, 2, 1)) < 1e-12
    scores = {r.id: r.lexical for r in lexical.bm25_scores(parts).collect()}
    assert scores[1] == 1.0 and 0 < scores[2] < 1


def test_saturation_counts_documents_without_a_score(spark):
    scores = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.96), (1, 3, 0.5)],
                                   "question_id bigint, id bigint, s double")
    row = lexical.saturation(scores, "s", spark.range(30).agg(F.count(F.lit(1)))).first()
    assert (row.at_maximum, row.near_maximum, row.top_spread) == (1, 2, 1.0)


def test_evidence_words(spark):
    assert sorted(value(spark, evidence_words(F.lit("The OrderTotal of an id")))) == ["order", "total"]


def test_bm25_of_whole_rows_equals_summed_contributions(spark):
    """Also where an id comes twice: as a copy, and with another text."""
    words = [f"t{i % 7} t{i % 5} t{i % 3} t{i % 7}" for i in range(40)]
    rows = spark.createDataFrame([(i, "s", text, ["u" + text]) for i, text in enumerate(words)]
                                 + [(3, "s", words[3], ["u" + words[3]]), (4, "s", "t1 t1 other", ["x"])],
                                 "id bigint, schema_text string, title string, columns array<string>")
    asked = spark.createDataFrame([(1, "t1 t2 t2 zz"), (2, "t6"), (3, "nowhere")], "question_id bigint, text string")
    bags = lexical.flattened_tokens(rows)
    expected = {(r.question_id, r.id): (r.bm25_raw, r.lexical)
                for r in lexical.bm25_scores(lexical.bm25_contributions(asked, bags)).collect()}
    got = lexical.bm25_rows(asked, bags)
    held = got.collect()
    assert len({r.id for r in held}) == len(held)
    assert {(q, r.id): pair for r in held for q, *pair in zip(r.asked, r.raw, r.scores)} == {
        key: list(pair) for key, pair in expected.items()}
    best = lexical.best_rows(got.coalesce(1), 2).collect()
    for question in (1, 2):
        wanted = sorted(((pair[1], i) for (q, i), pair in expected.items() if q == question), reverse=True)[:2]
        assert sorted(((r.lexical, r.id) for r in best if r.question_id == question), reverse=True) == wanted


def test_a_task_holds_few_rows_at_once(spark):
    from askgrid.operators.bounded import SLICE_ROWS, in_slices
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * SLICE_ROWS + 1))], names=["id"])
    assert [part.num_rows for part in in_slices([batch])] == [SLICE_ROWS, SLICE_ROWS, 1]
