import json
import random
import re

from pyspark.sql import functions as F

from askgrid.operators import captions, chunks, documents
from askgrid.operators import relationship_graph as rg
from askgrid.sources import catalog as cat
from askgrid.sources import query_log

NESTED = {"tables": [
    {"schema": "app_a", "name": "OrderLine", "description": " Lines ", "columns": [
        {"name": "OrderID", "data_type": "int", "nullable": False, "identity": True},
        {"name": "LineNo", "data_type": "nvarchar", "max_length": -1, "nullable": True, "identity": False,
         "description": "Number"},
        {"name": "Amount", "data_type": "decimal", "precision": 18, "scale": 2, "nullable": True,
         "identity": False, "description": "  "}],
     "primary_key": ["OrderID", "LineNo"],
     "foreign_keys": [
         {"constraint_name": "FK_B", "columns": ["LineNo", "OrderID"],
          "references": {"schema": "app_a", "table": "Order", "columns": ["No", "ID"]}},
         {"constraint_name": "FK_A", "column": "OrderID",
          "references": {"schema": "app_a", "table": "OrderLine", "column": "OrderID"}}]},
    {"schema": "app_a", "name": "Order", "description": None, "columns": [
        {"name": "ID", "data_type": "bigint", "nullable": False, "identity": True}],
     "primary_key": ["ID"], "foreign_keys": []},
    {"schema": "other", "name": "Lonely", "description": None, "columns": [], "primary_key": [],
     "foreign_keys": []}]}


def load(spark, tmp_path):
    path = tmp_path / "schema.json"
    path.write_text(json.dumps(NESTED, indent=1), encoding="utf-8")
    return cat.read_json(spark, str(path))


def test_documents(spark, tmp_path):
    catalog = load(spark, tmp_path)
    texts = {r.full_name: r.text for r in documents.render(catalog).collect()}
    assert texts["app_a.OrderLine"] == "\n".join([
        "Table: app_a.OrderLine", "Table words: Order Line", "Description: Lines",
        "PRIMARY KEY (OrderID, LineNo)", "", "Columns:",
        "- OrderID (Order I D) INT [PRIMARY KEY, IDENTITY, NOT NULL, FOREIGN KEY REFERENCES "
        "app_a.OrderLine.OrderID, FOREIGN KEY REFERENCES app_a.Order.ID]",
        "- LineNo (Line No) NVARCHAR(MAX) [PRIMARY KEY, NULL, FOREIGN KEY REFERENCES app_a.Order.No]",
        "  Description: Number", "- Amount (Amount) DECIMAL(18,2) [NULL]", "", "Relationships:",
        "- FK_A: FOREIGN KEY (OrderID) REFERENCES app_a.OrderLine (OrderID).",
        "- FK_B: FOREIGN KEY (LineNo, OrderID) REFERENCES app_a.Order (No, ID).",
        "- FK_A: app_a.OrderLine (OrderID) references app_a.OrderLine (OrderID)."])
    assert texts["other.Lonely"].endswith("Relationships:\n- No foreign-key relationships.")
    read = documents.render(catalog).select("full_name", documents.own_columns(F.col("text")).alias("c"))
    assert {r.full_name: r.c for r in read.collect()}["app_a.OrderLine"] == ["OrderID", "LineNo", "Amount"]


def test_edges_skip_self_incoming_and_unknown(spark, tmp_path):
    docs = documents.render(load(spark, tmp_path))
    assert [tuple(r) for r in rg.outgoing_edges(docs).collect()] == [("app_a.OrderLine", "app_a.Order")]
    only = docs.where("full_name <> 'app_a.Order'")
    assert rg.outgoing_edges(only).count() == 0


def test_prefix_and_assembly_round_trip(spark, tmp_path):
    catalog = load(spark, tmp_path)
    assert catalog.with_prefix(["APP_"]).tables.count() == 2
    nested = {r.name: r for r in cat.assemble(catalog).collect()}
    assert [k.constraint_name for k in nested["OrderLine"].foreign_keys] == ["FK_A", "FK_B"]
    assert nested["OrderLine"].foreign_keys[1].references.columns == ["No", "ID"]
    cat.write_json(catalog, str(tmp_path / "out"))
    import pytest
    with pytest.raises(Exception):
        cat.write_json(catalog, str(tmp_path / "out"))


def test_catalog_from_frames(spark):
    frame = spark.createDataFrame([(1, "a")], "k int, v string")
    columns = cat.from_frames(spark, {"t": frame}, "main").columns.orderBy("ordinal").collect()
    assert [(c.column, c.data_type, c.max_length) for c in columns] == [("k", "int", None), ("v", "string", -1)]


def test_form_edges_need_one_clear_primary(spark):
    rows = [(1, "a", True), (1, "b", False), (1, "c", False), (2, "a", True), (2, "b", True),
            (3, "a", True), (3, "a", False), (3, "b", False), (4, "a", None), (4, "b", True)]
    frame = spark.createDataFrame(rows, "form_id int, table string, is_primary boolean")
    assert sorted(tuple(r) for r in rg.form_edges(frame).collect()) == [
        ("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]


def pack(records, budget=12, header="h h"):
    return list(chunks._pack(header, records, budget, chunks.word_starts))


def test_packing_respects_budget_and_order():
    out = pack(["a b c", "d e f g", "h", "i j k l m n"])
    assert [(first, last) for first, last, *_ in out] == [(0, 2), (3, 3)]
    assert all(chunks.count_words(text) <= 12 for *_, text in out)
    assert pack([]) == [(0, -1, 1, 1, "h h")]


def test_long_records_are_split_loss_free():
    record = "  ".join(f"w{i}" for i in range(40))
    out = pack(["x", record, "y"])
    parts = [text.split("\n\n", 1)[1].split("\n", 1)[1] for first, _, part, parts, text in out if parts > 1]
    assert "".join(parts) == record and len(out) == len(parts) + 2
    assert all(chunks.count_words(text) <= 12 for *_, text in out)


def test_character_counter_is_pluggable(spark):
    frame = spark.createDataFrame([(1, "h", ["ab", "cd", "efghijklmnopqrstuv"])],
                                  "id bigint, header string, records array<string>")
    out = chunks.pack_chunks(frame, 20, lambda text: [m.start() for m in re.finditer(r"\S", text)]).collect()
    assert out[0].text == "h\n\nab\n\ncd" and len(out) == 2
    assert chunks.chunk_violations(frame, chunks.pack_chunks(frame, 60)).count() == 0


def test_even_spacing_and_fitting(spark):
    assert chunks.evenly_spaced(10, 4) == [0, 3, 6, 9]
    assert chunks.evenly_spaced(5, 0) == [] and chunks.evenly_spaced(5, 1) == [0]
    kept = spark.range(1).select(chunks.fitting(F.array(
        F.lit("a b"), F.lit("c d e f"), F.lit("g")), 1, 5).alias("k")).first().k
    assert kept == ["a b", "g"]
    unique = spark.range(1).select(chunks.normalized_unique(
        F.array(*map(F.lit, ["B  b", "a", "A", " ", "b B", "skip"])), F.array(F.lit("SKIP"))).alias("u")).first().u
    assert unique == ["a", "B b"]


def test_captions_pair_only_by_identity(spark):
    rows = [(1, 0, 0, "form", "Order"), (1, 0, 1, "form", "Bestellüng"), (2, 0, 0, "form", "Réf"),
            (1, None, 2, "form", "Other"), (1, None, 3, "form", "Ändere")]
    frame = spark.createDataFrame(rows, "table_id int, exchange int, turn int, level string, caption string")
    named = captions.classified(frame, "[À-ɏ]", "accented", "plain")
    pairs = captions.bilingual_pairs(named, ["table_id", "exchange"], "plain", "accented")
    assert [(r.plain, r.accented) for r in pairs.collect()] == [("Order", "Bestellüng")]
    assert sorted(r.caption for r in captions.queue(named, pairs, "accented").collect()) == ["Réf", "Ändere"]


def test_query_log(spark, tmp_path):
    path = str(tmp_path / "log")
    query_log.append(spark, [query_log.log_record(question="نمونه", execution_status="success", row_count=3)], path)
    query_log.append(spark, [query_log.log_record(question="b")], path)
    rows = query_log.read(spark, path).orderBy("question").collect()
    assert [r.question for r in rows] == ["b", "نمونه"] and rows[1].row_count == 3
    assert rows[0].retrieved_tables == []
    from askgrid.streaming.log_stream import log_stream, unscored
    stream = log_stream(spark, path)
    assert stream.isStreaming
    done = spark.createDataFrame([(1,)], "id bigint")
    assert unscored(spark.range(3), done, ["id"]).count() == 2


def greedy(header, records, budget, starts):
    """The chunks' record ranges by counting the assembled text for every record."""
    def fits(first, end):
        return len(starts("\n\n".join([header, *records[first:end]]))) <= budget

    out, first = [], 0
    while first < len(records):
        end = first
        while end < len(records) and fits(first, end + 1):
            end += 1
        out.append((first, max(end - 1, first)))
        first = max(end, first + 1)
    return out


def test_packing_equals_counting_everything():
    rng = random.Random(3)
    # Joints that cost tokens, joints that are free, joints that save one.
    counters = [chunks.word_starts, lambda text: [m.start() for m in re.finditer(r"\n|\S+", text)],
                lambda text: [m.start() for m in re.finditer(r"\w{1,3}|[^\w]+", text)],
                lambda text: list(range(len(text)))]
    for starts in counters:
        for _ in range(60):
            records = ["".join(rng.choice(["ab ", "x", "", "\n", " ", "longer "]) for _ in range(rng.randrange(9)))
                       for _ in range(rng.randrange(30))]
            budget = rng.choice([40, 60, 90])
            found = list(chunks._pack("h: 1", records, budget, starts))
            ranges = list(dict.fromkeys((first, last) for first, last, *_ in found if last >= first))
            assert ranges == greedy("h: 1", records, budget, starts)
            assert all(len(starts(text)) <= budget for *_, text in found)


def test_altered_and_lost_texts_are_found(spark):
    rows = spark.createDataFrame(
        [("a", "h", ["one two", "three"] * 9), ("b", "h", ["w " * 60, "", "end"]), ("c", "h", []), ("d", "h", None)],
        "id string, header string, records array<string>")
    packed = chunks.pack_chunks(rows, 12).cache()

    def problems(frame):
        return sorted((r.id, r.problem) for r in chunks.chunk_violations(rows, frame, 12).collect())

    assert problems(packed) == []
    changed = F.when((F.col("id") == "a") & (F.col("chunk_no") == 1), F.upper("text"))
    assert problems(packed.withColumn("text", F.coalesce(changed, "text"))) == [("a", "text differs")]
    assert problems(packed.where("NOT (id = 'b' AND part = 3)")) == [("b", "text differs")]
    emptied = packed.withColumn("text", F.when(F.col("id") == "c", "").otherwise(F.col("text")))
    assert problems(emptied) == [("c", "text differs")]
    packed.unpersist()
