"""Decontamination against a plain scan."""

import re

from fixtures import documents, empty, texts, words
from pyspark.sql import functions as F

from askgrid.llm import decontaminate
from askgrid.llm.common import UPPER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(UPPER, UPPER.lower())


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    found, hit, own = set(), set(), split(text)
    for item, item_text in items:
        listed = split(item_text)
        if not listed:
            continue
        n = min(13, len(listed))
        windows = {tuple(listed[k:k + n]) for k in range(len(listed) - n + 1)}
        for k in range(len(own) - n + 1):
            if tuple(own[k:k + n]) in windows:
                found.add(item)
                hit.update(range(k, k + n))
    return len(own), len(hit), found


ITEMS = [(1, words(40, 1)), (2, "one TWO three"), (2, words(40, 1)), (3, None), (4, "..."), (10, "Ärger über"),
         (None, "four five"), (5, " ".join(words(20_000, 2).split()[700:760])), (6, "über öl ärger über Öl")]


def test_hits_equal_a_plain_scan(spark):
    rows = texts() + [(20, "b " * 500 + "four. five"), (21, words(10, 9) + " " + words(40, 1) + " z")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (decontaminate.MAX_BROADCAST_WINDOWS, 2):
        found = decontaminate.find_hits(documents(spark, rows), items, limit=limit).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r.item_ids)) for r in found), key=repr)
        expected = [(i, *brute(t, ITEMS)) for i, t in rows]
        assert got == sorted(((i, n, h, sorted(k for k in s if k is not None)) for i, n, h, s in expected), key=repr)


def test_documents_and_spans_go(spark):
    rows = [(1, "Keep this. " + words(40, 1) + " end."), (2, "clean text"), (None, words(40, 1)), (3, None),
            (4, words(5000, 9) + " " + words(13, 1)), (4, words(5000, 9) + " " + words(13, 1))]
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    docs = documents(spark, rows)
    kept = decontaminate.drop_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["2", "3", "4", "4"]
    clean = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert clean == {1: "Keep this end.", 2: "clean text", None: "", 3: None, 4: words(5000, 9)}


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.find_hits(documents(spark), items).collect()
    assert len(found) == len(texts()) and all(r.n_hit == 0 and r.item_ids == [] for r in found)
    assert decontaminate.find_hits(empty(spark), items).count() == 0


def test_clashing_names(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    names = ("_bad_id", "_bad_key", "bad_id", "_hit_id", "_hit_key", "hit_key", "text_key", "hits", "parts", "row", "key")
    docs = documents(spark).withColumns({name: F.lit(7) for name in names if name != "row"})
    for step in (decontaminate.drop_documents, decontaminate.remove_spans):
        plain, wide = step(documents(spark), items), step(docs, items)
        assert wide.columns == docs.columns
        assert sorted(map(repr, plain.select("doc_id", "text").collect())) == sorted(
            map(repr, wide.select("doc_id", "text").collect()))
        assert step(empty(spark), items).count() == 0
        assert step(docs, items.where("false")).count() == docs.count()
