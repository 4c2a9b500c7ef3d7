"""Sharding: every record once, equal counts, gapless slots, no dependence on the input's layout."""

from collections import Counter, defaultdict

import pytest
from fixtures import documents, empty, texts

from askgrid.llm import shards


@pytest.mark.parametrize("bucket_bytes", [2_000, 10 ** 8])
def test_counts_and_slots(spark, bucket_bytes):
    docs = documents(spark)
    rows = shards.shuffle_into_shards(docs, 5, bucket_bytes=bucket_bytes).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.row) for r in rows) == Counter(
        (i, t, "en", 1) for i, t in texts())
    slots = defaultdict(list)
    for row in rows:
        slots[row.shard].append(row.slot)
    counts = [len(slots[k]) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(held) == list(range(len(held))) for held in slots.values())


def test_layout_of_the_input_does_not_matter(spark):
    docs = documents(spark, [(i, f"text {i % 7}") for i in range(500)])
    one = shards.shuffle_into_shards(docs, 24, bucket_bytes=700)
    two = shards.shuffle_into_shards(docs.repartition(7).orderBy("text"), 24, bucket_bytes=700)
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))
    other = shards.shuffle_into_shards(docs, 24, seed=5, bucket_bytes=700)
    assert Counter(map(tuple, one.collect())) != Counter(map(tuple, other.collect()))


def test_repeated_rows_and_uniformity(spark):
    docs = documents(spark, [(1, "same")] * 300 + [(i, "t") for i in range(2, 700)])
    rows = shards.write_shards(docs, 4, bucket_bytes=500).collect()
    assert len(rows) == 998
    rows = shards.write_shards(docs.where("doc_id > 1"), 4, bucket_bytes=500).collect()
    low = Counter(row.shard for row in rows if row.doc_id < 350)
    assert min(low.values()) > 60


def test_fewer_rows_than_shards_and_none(spark):
    rows = shards.shuffle_into_shards(documents(spark, [(1, "a"), (2, None)]), 24).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (1, 0)]
    assert shards.write_shards(empty(spark)).count() == 0
