"""Near duplicates against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from fixtures import documents, empty, texts, words
from pyspark.sql import functions as F

from askgrid.llm import minhash, settle


def brute(rows, percent=85):
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, set())
            sets[doc_id] |= {frozenset(minhash.shingle_set((text or "").encode()))}
    root = {doc_id: doc_id for doc_id in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        (one,), (two,) = sets[a], sets[b]
        if one and two and 100 * len(one & two) >= percent * len(one | two):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {doc_id: (len(next(iter(sets[doc_id]))), find(doc_id)) for doc_id in sets}


def family(seed, copies, changes, n=200, first=1000):
    """A text and copies with a few words changed each."""
    rng = random.Random(seed)
    base = words(n, seed).split()
    out = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(n)] = f"x{rng.random()}"
        out.append(" ".join(own))
    rng.shuffle(out)
    return [(first + i, text) for i, text in enumerate(out)]


def check(spark, rows, **options):
    found = minhash.near_duplicates(documents(spark, rows), **options).collect()
    expected = brute(rows)
    assert len(found) == len(rows)
    for row in found:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id) == expected[row.doc_id], row
            assert row.kept == (row.doc_id == row.component_id)


def test_odd_rows(spark):
    check(spark, texts())
    assert minhash.near_duplicates(empty(spark)).count() == 0
    kept = minhash.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    expected = brute(texts())
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(repr, ids)) == sorted(repr(i) for i, _ in texts() if i is None or expected[i][1] == i)


def test_rows_of_one_id_are_one_document(spark):
    from test_ngram_join import brute as by_row
    rows = [(1, words(60, 1)), (1, words(60, 2)), (2, words(60, 2)), (3, words(60, 1)), (4, words(60, 4)),
            (4, words(60, 5)), (5, words(60, 5)), (5, None), (6, None)]
    found = minhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(repr, (tuple(r)[:3] for r in found))) == sorted(map(repr, by_row(rows, 85, 5)))
    kept = {}
    for row in found:
        kept.setdefault(row.doc_id, set()).add(row.kept)
    assert {i for i, seen in kept.items() if seen == {True}} >= {1, 4, 6} and kept[2] == kept[3] == {False}


def test_clashing_names(spark):
    docs = documents(spark).withColumns({name: F.lit(1) for name in (
        "_gone", "gone", "node", "label", "bucket_", "a", "b", "n_shingles", "component_id", "kept")})
    assert minhash.drop_near_duplicates(docs).columns == docs.columns
    assert minhash.drop_near_duplicates(docs).count() == minhash.drop_near_duplicates(documents(spark)).count()


@pytest.mark.parametrize("rounds, block_rows", [(5, 512), (1, 7)])
def test_families_equal_all_pairs(spark, rounds, block_rows):
    rows = family(3, 60, 9) + family(4, 30, 5, first=2000) + family(5, 5, 14, first=3000)
    rows += [(5000 + i, words(150, 50 + i)) for i in range(30)]
    # A chain whose ends are far apart, linked step by step.
    chain = words(200, 77).split()
    for k in range(12):
        chain[k * 3:k * 3 + 3] = [f"c{k}a", f"c{k}b", f"c{k}c"]
        rows.append((4000 + k, " ".join(chain)))
    check(spark, rows, rounds=rounds, block_rows=block_rows)


def test_blocks_join_all_labels(spark):
    """The complete pairing of open buckets, without any star: every link is found or implied."""
    rows = family(9, 40, 4)
    docs = documents(spark, rows)
    nodes = minhash.sketches(docs).select(F.col("doc_id").alias("node"), "signature", "bands").cache()
    buckets = settle.distinct_buckets(nodes.select("node", F.explode("bands").alias("bucket")), "test")
    single = nodes.select("node", F.col("node").alias("label"))
    labelled = settle.open_buckets(buckets, single, 1).select("bucket", "node", "label", "major")
    sets = {i: minhash.shingle_set(t.encode()) for i, t in rows}
    members = {}
    for row in labelled.collect():
        members.setdefault(row.bucket, set()).add(row.node)
    expected = {(a, b) for own in members.values() for a, b in combinations(sorted(own), 2)
                if minhash.reaches(sets[a], sets[b], 85)}
    texts = docs.select("doc_id", "text")
    for block_rows in (512, 6):
        left = minhash.open_rows(labelled, nodes, 0.85, 125, block_rows)
        found = {tuple(sorted((r.a, r.b)))
                 for r in minhash.block_links(left, nodes.drop("bands"), texts, 85, 125, block_rows=block_rows).collect()}
        assert found == expected


@pytest.mark.parametrize("loose, rounds", [(3, 1), (150, 5)])
def test_star_rounds_end_when_few_pairs_are_left(spark, loose, rounds):
    """200 nodes of a bucket; of ``loose`` ones the stars find no link, the complete pairing does."""
    rows = spark.createDataFrame([(1, node) for node in range(200)], "bucket long, node long")
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.where(F.greatest("a", "b") < 200 - loose)

    def across(left):
        assert left.where("label <> major").count() == loose
        return left.where("label <> major").select(F.lit(0).cast("long").alias("a"), F.col("node").alias("b"))

    labels = settle.settle(settle.distinct_buckets(rows, "test"), verify, across, "test")
    assert {(r.node, r.label) for r in labels.collect()} == {(node, 0) for node in range(200)}
    assert len(seen) == rounds


def test_posterior_bounds():
    rng = np.random.default_rng(3)
    draws = rng.beta(80 + 1, 20 + 1, 400_000)
    assert abs(minhash.posterior_reaches(80, 100, 0.85) - (draws >= 0.85).mean()) < 0.003
    steps = minhash.least_matches(125, 0.85)
    assert [k for k, _ in steps] == [25, 50, 75, 100, 125]
    for n, needed in steps:
        assert minhash.posterior_reaches(needed, n, 0.85) >= minhash.MISS > minhash.posterior_reaches(needed - 1, n, 0.85)


def test_signatures_estimate_similarity():
    one = minhash.shingle_hashes(words(400, 1).encode())
    two = np.r_[one[:300], minhash.shingle_hashes(words(104, 8).encode())]
    same = (minhash.minima(one, 2000) == minhash.minima(two, 2000)).mean()
    real = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    assert abs(same - real) < 0.04
