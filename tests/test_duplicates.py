import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from askgrid.operators import near_duplicates as dup
from askgrid.operators.components import cluster_ids, connected_components
from askgrid.session import ensure_checkpoint_dir


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 31)],
    [(random.Random(1).randint(0, 40), random.Random(i).randint(0, 40)) for i in range(25)], [(3, 3)]])
def test_components(spark, edges):
    nodes = list(range(42))
    frame = connected_components(spark.createDataFrame([(n,) for n in nodes], "id bigint"),
                                 spark.createDataFrame(edges, "left bigint, right bigint"))
    assert {r.id: r.root for r in frame.collect()} == components(nodes, edges)


def test_rounds_of_components_are_tables(spark):
    """A checkpoint would run each round's last stage twice."""
    edges = spark.range(40).select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    found = connected_components(spark.range(41), edges)
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert {r.root for r in found.collect()} == {0}


def test_cluster_ids(spark):
    members = spark.createDataFrame([(3, 1), (1, 1), (10, 1), (7, 7)], "id bigint, root bigint")
    got = {r.root: (r.cluster_id, r.member_count) for r in cluster_ids(members).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got[1] == ("rc-" + digest("1,3,10")[:16], 3)
    assert got[7] == ("rc-" + digest("7")[:16], 1)
    split = {r.root: r.cluster_id for r in cluster_ids(members, part_size=5).collect()}
    assert split == {root: cluster_id for root, (cluster_id, _) in got.items()}
    large = members.union(spark.createDataFrame([(200_000, 1)], "id bigint, root bigint"))
    assert {r.root: r.cluster_id for r in cluster_ids(large).collect()}[1] == "rc-" + digest("1,3,10,200000")[:16]
    with pytest.raises(Exception, match="too many members"):
        cluster_ids(members, max_members=2).collect()


def corpus(seed):
    """Texts with a large family of near copies, exact copies and unrelated ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    base = vocabulary[:40]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, f"s{rng.randint(0, 2)}", " ".join(words)))
    for i in range(60, 75):
        rows.append((i, "s1", rows[5][2]))
    for i in range(75, 110):
        rows.append((i, f"s{rng.randint(0, 3)}", " ".join(rng.sample(vocabulary, rng.randint(3, 30)))))
    rows.append((110, "s1", "  "))
    return rows


def brute_force(rows):
    sets = {i: frozenset(t.split()) for i, _, t in rows if t.strip()}
    labels = {i: s for i, s, _ in rows}
    edges = []
    for a in sets:
        for b in sets:
            if a < b:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.85 or (j >= 0.5 and labels[a] == labels[b]):
                    edges.append((a, b))
    return components(sets, edges), edges, sets


@pytest.mark.parametrize("large", [2000, 6])
def test_clusters_equal_all_pairs(spark, large, monkeypatch):
    monkeypatch.setattr(dup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(dup, "PIVOT_ROUNDS", 1)
    rows = corpus(4)
    frame = spark.createDataFrame(rows, "id bigint, label string, text string")
    nodes, members, labels = dup.nodes_and_members(dup.prepared_texts(frame))
    links = dup.node_links(nodes, labels, large)
    roots = connected_components(nodes.select(F.col("node").alias("id")), links)
    node_root = {r.id: r.root for r in roots.collect()}
    got = {r.id: node_root[r.node] for r in members.collect()}
    expected, edges, sets = brute_force(rows)
    assert got == expected
    least = {}
    for i, s in sets.items():
        least[s] = min(least.get(s, i), i)
    wanted = {tuple(sorted((least[sets[a]], least[sets[b]]))) for a, b in edges if sets[a] != sets[b]}
    every = dup.node_links(nodes, labels, large, complete=True)
    assert {(r.left, r.right) for r in every.collect()} == wanted


def test_exact_groups(spark):
    frame = spark.createDataFrame([(1, "s", "A  b"), (2, "s", "A b "), (3, "s", "a b"), (4, "s", "")],
                                  "id bigint, label string, text string")
    got = {r.id: (r.representative, r.copies) for r in dup.exact_groups(dup.prepared_texts(frame)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_compatibility_forms_and_case_fold_to_the_same_words(spark):
    frame = spark.createDataFrame([(1, "s", "ﬁne Straße x²"), (2, "s", "FINE STRASSE x2")],
                                  "id bigint, label string, text string")
    hashes = {r.set_hash for r in dup.prepared_texts(frame).collect()}
    assert len(hashes) == 1


def test_pairs_that_merely_share_some_words_are_not_compared(spark, monkeypatch):
    """Unrelated texts share rare words in many pairs; whole sets meet only where enough is shared."""
    rng = random.Random(9)
    rows = [(i, "s0", " ".join(rng.sample([f"w{n}" for n in range(400)], 30))) for i in range(150)]
    rows += [(200 + i, "s0", rows[i][2] + " more") for i in range(5)]
    frame = spark.createDataFrame(rows, "id bigint, label string, text string")
    nodes, _, labels = dup.nodes_and_members(dup.prepared_texts(frame))
    monkeypatch.setattr(dup, "CELL_COUNTERS", 5_000)
    compared, measure = [], dup._similarity

    def counted(pairs, sets):
        compared.append(pairs.count())
        return measure(pairs, sets)

    monkeypatch.setattr(dup, "_similarity", counted)
    got = {(r.left, r.right) for r in dup.node_links(nodes, labels, complete=True).collect()}
    assert got == {(i, 200 + i) for i in range(5)}
    assert sum(compared) < 100


def folder_bytes(spark):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return sum(file.stat().st_size for file in folder.rglob("*") if file.is_file())


def test_links_leave_less_on_disk_than_the_words_take(spark):
    """Word hashes were written and dealt to cells again and again; sketches take a bit of that."""
    rng = random.Random(3)
    rows = [(i, f"s{i % 2}", " ".join(f"w{rng.randrange(100_000)}" for _ in range(250))) for i in range(400)]
    rows += [(1000 + i, "s3", rows[i][2] + " more") for i in range(5)]
    frame = spark.createDataFrame(rows, "id bigint, label string, text string")
    before = folder_bytes(spark)
    nodes, _, labels = dup.nodes_and_members(dup.prepared_texts(frame))
    found = dup.node_links(nodes, labels, complete=True).collect()
    assert {(r.left, r.right) for r in found} == {(i, 1000 + i) for i in range(5)}
    assert folder_bytes(spark) - before < 8 * 250 * len(rows) / 2


def test_sketches_never_rule_out_a_link():
    """Bits of a sketch differ in no more places than the sets in words, folded or not."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    sets = [[rng.randrange(-2**63, 2**63) for _ in range(rng.choice([1, 3, 40, 300]))] for _ in range(12)]
    sets += [[*words[:-1], rng.randrange(2**63)] for words in sets]
    sketches = [np.frombuffer(x, dtype=np.uint64) for x in dup._sketch.func(pa.array(sets, pa.list_(pa.int64()))).to_pylist()]
    for a, left in zip(sets, sketches):
        for b, right in zip(sets, sketches):
            for width in (1, 2, min(len(left), len(right))):
                bits = dup._folded(left[None, :], width) ^ dup._folded(right[None, :], width)
                assert np.bitwise_count(bits).sum() <= len(set(a) ^ set(b))


def test_a_set_goes_to_a_task_once(spark, monkeypatch):
    """Every pair carried the words of one of its sets through the shuffle."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "s0", " ".join(words + [f"x{i}"])) for i in range(40)]
    frame = spark.createDataFrame(rows, "id bigint, label string, text string")
    sent, jaccards = spark.sparkContext.accumulator(0), dup._jaccards

    def counted(pairs, sets):
        sent.add(sets.num_rows)
        return jaccards(pairs, sets)

    monkeypatch.setattr(dup, "_jaccards", counted)
    nodes, _, labels = dup.nodes_and_members(dup.prepared_texts(frame))
    found = dup.node_links(nodes, labels, complete=True).collect()
    assert len({(r.left, r.right) for r in found}) == 40 * 39 / 2
    assert {r.reasons for r in found} == {"jaccard,same_label"}
    assert sent.value == 40


def test_later_pages_deal_only_cells_with_nodes_that_have_further_candidates(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "s0", " ".join(words + [f"x{i}"])) for i in range(20)]
    rows += [(100 + i, f"s{1 + i % 3}", " ".join(rng.sample([f"v{n}" for n in range(5000)], 400))) for i in range(90)]
    frame = spark.createDataFrame(rows, "id bigint, label string, text string")
    dealt, cells = [], dup._cells

    def counted(*args):
        found = cells(*args)
        dealt.append(found.where("node >= 100").count())
        return found

    monkeypatch.setattr(dup, "_cells", counted)
    nodes, _, labels = dup.nodes_and_members(dup.prepared_texts(frame))
    roots = connected_components(nodes.select(F.col("node").alias("id")), dup.node_links(nodes, labels, 3))
    assert {r.root for r in roots.where("id < 100").collect()} == {0}
    assert roots.where("id >= 100 AND root = id").count() == 90
    assert sum(dealt[:2]) > 0 and len(dealt) > 2 and sum(dealt[2:]) == 0


def test_rows_are_shuffled_to_their_cells_once(spark):
    """A join with the sizes of the cells dealt all sketches by label and class first."""
    rows = [(i, "s0", 50 + i % 3, bytes(16), i, True) for i in range(20)]
    frame = spark.createDataFrame(rows, "node bigint, label string, size int, sketch binary, root bigint, open boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = dup._cells(frame, ["label"], 0.5)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert cells.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_one_inspected_member_removes_its_cluster(spark, tmp_path):
    """Through the query, with a copy, a near copy, a text without words, nulls and unrelated texts."""
    from askgrid.plans import corpus
    from askgrid.sources.tables import Tables

    words = [f"w{i}" for i in range(50)]
    texts = {1: " ".join(words), 2: " ".join(words), 3: " ".join(words + ["x"]), 4: "other words here", 5: "...", 6: " ", 7: None,
             8: " ".join(f"v{i}" for i in range(40)), 9: " ".join(f"v{i}" for i in range(41))}
    spark.createDataFrame([(i, text, "en", "s0", len(text or "")) for i, text in texts.items()],
                          "doc_id bigint, text string, lang string, source string, n_chars int") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 1), (8, 1, 0), (4, 0, None)], "doc_id bigint, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    before = folder_bytes(spark)
    tables = Tables(spark, str(tmp_path))
    assert {(r.root, r.member_count) for r in corpus.contamination_filter(tables).collect()} == {(4, 1), (5, 1), (8, 2)}
    assert {(r.id, r.root) for r in corpus.duplicate_clusters(tables).collect()} == {
        (1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (8, 8), (9, 8)}
    assert folder_bytes(spark) > before
