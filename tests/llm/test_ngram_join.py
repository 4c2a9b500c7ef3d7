"""The n-gram join against all pairs."""

from itertools import combinations

import numpy as np
import pytest
from fixtures import documents, empty, texts, words
from pyspark.sql import functions as F
from test_minhash import family

from askgrid.llm import minhash, ngram_join, settle


def brute(rows, percent=90, width=3):
    """(n_shingles, component_id) per row."""
    sets = [minhash.shingle_set((text or "").encode(), width) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, (i, _)), (b, (j, _)) in combinations(enumerate(rows), 2):
        one, two = sets[a], sets[b]
        same = i == j and i is not None
        if i is not None and j is not None and one and two and (
                same or 100 * len(one & two) >= percent * len(one | two)):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows)]


def check(spark, rows, **options):
    found = ngram_join.similar_documents(documents(spark, rows), **options).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))


def test_odd_rows(spark):
    rows = texts() + [(1, words(40, 9)), (30, words(40, 9)), (1, None), (31, words(250, 3))]
    check(spark, rows)
    assert ngram_join.similar_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("rounds, block_rows, grams", [(5, 512, 2_000_000), (1, 7, 500)])
def test_families_equal_all_pairs(spark, rounds, block_rows, grams):
    rows = family(3, 60, 9) + family(4, 30, 5, first=2000) + family(5, 5, 14, first=3000)
    passage = words(60, 99)
    rows += [(5000 + i, words(90, 50 + i) + " " + passage) for i in range(30)]  # a passage that many share
    chain = words(200, 77).split()
    for k in range(12):
        chain[k * 3:k * 3 + 3] = [f"c{k}a", f"c{k}b", f"c{k}c"]
        rows.append((4000 + k, " ".join(chain)))
    check(spark, rows, rounds=rounds, block_rows=block_rows, batch_grams=grams, fragment_grams=grams)


def test_shared_counts_keep_every_partner(spark):
    rows = family(8, 20, 6) + [(9000 + i, words(120, 300 + i)) for i in range(20)]
    sets = {i: set(minhash.shingle_hashes(t.encode(), 3).tolist()) for i, t in rows}
    for grams in (1000, 10_000_000):
        kept = {r.doc_id for r in ngram_join.shared_counts(documents(spark, rows), 10_000, 3, 90, grams, grams).collect()}
        expected = {i for i, own in sets.items()
                    if 100 * len(own & set().union(*(s for j, s in sets.items() if j != i))) >= 90 * len(own)}
        assert expected <= kept and len(kept - expected) <= 1


def test_large_group_is_dealt_in_proportion(spark):
    """Copies of a group's outside nodes only; nodes of the largest label once."""
    n, outside = 3000, 40
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"),
        F.when(F.col("id") < outside, F.col("id")).otherwise(F.lit(outside)).alias("label"),
        F.lit(outside).cast("long").alias("major"))
    payload = spark.range(n).select(F.col("id").alias("node"), F.lit(100).cast("long").alias("bytes"))
    assert settle.deal(rows, payload, "bytes").count() == n + outside * 6
    pairs = []
    for table, copies in settle.blocks(settle.deal(rows, payload, "bytes").toArrow().to_batches(100)):
        node, label, major = (table.column(k).to_numpy() for k in ("node", "label", "major"))
        for row in range(copies.num_rows):
            pairs += [(copies.column(3)[row].as_py(), int(node[k]))
                      for k in settle.partners(table, copies, row, label, node, major)]
    expected = {(a, b) for a in range(outside) for b in range(a + 1, n)}
    assert len(pairs) == len(expected) and {tuple(sorted(p)) for p in pairs} == expected


def test_star_pairs_grow_with_the_rows(spark):
    nodes = spark.range(2000).select(F.lit(5).cast("long").alias("bucket"), F.col("id").alias("node"))
    buckets = settle.distinct_buckets(nodes, "test")
    assert settle.star_pairs(settle.open_buckets(buckets, None, 0), 0).count() == 1999
    labels = nodes.select("node", (F.col("node") % 2).alias("label"))
    assert settle.star_pairs(settle.open_buckets(buckets, labels, 1), 1).count() <= 2000
    assert np.array(settle.open_buckets(buckets, nodes.select("node", F.lit(0).cast("long").alias("label")), 1).collect()).size == 0
