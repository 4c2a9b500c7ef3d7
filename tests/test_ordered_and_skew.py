import random

from pyspark.sql import functions as F

from askgrid.operators.ordered import asof_join, latest_per_key, range_join_by_month, running_sum
from askgrid.operators.quantiles import median, nearest_rank
from askgrid.operators.metrics import average_rank
from askgrid.operators.sampling import allocate, first_match, hash_positions
from askgrid.operators.skew import attach_by_key, group_values_over

random.seed(5)
# One key holds most rows.
ROWS = [(1 if random.random() < 0.7 else random.randint(2, 9), random.randint(0, 400), i,
         random.randint(-5, 9)) for i in range(600)]


def rows(spark):
    return spark.createDataFrame(ROWS, "k bigint, day int, id bigint, v bigint").repartition(4)


def test_group_values_with_split_heavy_key(spark):
    expected = {}
    for k, _, _, v in ROWS:
        expected[k] = expected.get(k, 0) + v
    out = group_values_over(rows(spark), ["k"], {"total": F.sum("v")}, target_rows=20).collect()
    assert len(out) == len(ROWS)
    assert all(r.total == expected[r.k] for r in out)


def test_null_keys_meet_their_group(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), (3, 4)], "k bigint, v bigint")
    out = sorted((r.v, r.n) for r in group_values_over(frame, ["k"], {"n": F.count(F.lit(1))}, 1).collect())
    assert out == [(1, 2), (2, 2), (4, 1)]


def test_attach_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, x string")
    right = spark.createDataFrame([(1, 5)], "k bigint, n bigint")
    assert sorted((r.k, r.n) for r in attach_by_key(left, right, ["k"], "n", 2).collect()) == [(1, 5), (2, None)]


def test_running_sum_equals_brute_force(spark):
    frame = rows(spark)
    got = {r.id: r.total for r in running_sum(frame, ["k"], ["day", "id"], F.floor(F.col("day") / 30),
                                              "v", "total").collect()}
    sums = {}
    for k, _, i, v in sorted(ROWS):
        sums[k] = sums.get(k, 0) + v
        assert got[i] == sums[k]


def test_latest_per_key(spark):
    got = {r.k: r.id for r in latest_per_key(rows(spark), ["k"], ["day", "id"]).collect()}
    assert got == {k: max((d, i) for kk, d, i, _ in ROWS if kk == k)[1] for k in got}


def test_asof_join_equals_brute_force(spark):
    history = [(k, d, i) for k, d, i, _ in ROWS[::3]]
    probes = [(k, d, i) for k, d, i, _ in ROWS[1::3]] + [(77, 5, 9999)]
    left = spark.createDataFrame(probes, "k bigint, at int, pid bigint").repartition(3)
    right = spark.createDataFrame(history, "k bigint, start int, hid bigint").repartition(3)
    got = {r.pid: r.hid for r in asof_join(left, right, ["k"], "at", "start", ["hid"], ["hid"],
                                           lambda t: F.floor(t / 25)).collect()}
    assert len(got) == len(probes)
    for k, at, pid in probes:
        matches = [(s, h) for kk, s, h in history if kk == k and s <= at]
        assert got[pid] == (max(matches)[1] if matches else None)


def test_range_join_by_month(spark):
    facts = spark.sql("SELECT * FROM VALUES (1, DATE'2020-01-31'), (2, DATE'2020-02-01'), (3, DATE'2020-06-01') f(id, at)")
    periods = spark.sql("SELECT * FROM VALUES ('a', DATE'2020-01-15', DATE'2020-02-10'), ('b', DATE'2020-01-01', DATE'2020-01-31') p(p, s, e)")
    got = sorted((r.id, r.p) for r in range_join_by_month(facts, periods, "at", "s", "e").collect())
    assert got == [(1, "a"), (1, "b"), (2, "a")]


def test_quantiles(spark):
    frame = rows(spark)
    bucket = F.floor(F.col("day") / 50)
    p = {r.k: r.p95 for r in nearest_rank(frame, ["k"], "day", bucket, {"p95": 0.95}).collect()}
    m = {r.k: r.median for r in median(frame, ["k"], "day", bucket).collect()}
    import math
    import statistics
    for k in p:
        values = sorted(d for kk, d, _, _ in ROWS if kk == k)
        assert p[k] == values[max(0, math.ceil(0.95 * len(values)) - 1)]
        assert m[k] == statistics.median(values)


def test_average_rank(spark):
    frame = spark.createDataFrame([(1, v) for v in (10, 20, 20, 30)], "k bigint, v int")
    got = sorted((r.v, r.r) for r in average_rank(frame, ["k"], "v", "r", F.floor(F.col("v") / 15)).collect())
    assert got == [(10, 1.0), (20, 2.5), (20, 2.5), (30, 4.0)]


def largest_remainder(counts, target):
    names = sorted(n for n in counts if counts[n])
    rest, total = target - len(names), sum(counts.values())
    quota = {n: rest * counts[n] / total for n in names}
    out = {n: 1 + int(quota[n]) for n in names}
    for n in sorted(names, key=lambda n: (-(quota[n] - int(quota[n])), n))[:target - sum(out.values())]:
        out[n] += 1
    return out


def test_allocation(spark):
    counts = {"a": 17, "b": 3, "c": 1, "d": 40, "e": 0}
    frame = spark.createDataFrame(list(counts.items()), "s string, n bigint")
    got = {r.s: r.allocated for r in allocate(frame, "s", 12).collect()}
    assert got == largest_remainder(counts, 12) and sum(got.values()) == 12


def test_allocation_refuses_too_many_strata(spark):
    import pytest
    frame = spark.createDataFrame([("a", 1), ("b", 1)], "s string, n bigint")
    with pytest.raises(Exception, match="smaller"):
        allocate(frame, "s", 1).collect()


def test_hash_positions(spark):
    import hashlib
    frame = spark.createDataFrame([("x" if i % 5 else "y", i) for i in range(80)], "s string, id bigint")
    got = {r.id: r.position for r in hash_positions(frame, "s", "salt ").collect()}
    for s in ("x", "y"):
        ids = [i for i in range(80) if (i % 5 != 0) == (s == "x")]
        order = sorted(ids, key=lambda i: hashlib.sha256(f"salt {i}".encode()).hexdigest())
        assert [got[i] for i in order] == list(range(1, len(ids) + 1))


def test_first_match(spark):
    rule = first_match([("low", F.col("id") < 2), ("even", F.col("id") % 2 == 0)], "other")
    assert [r.c for r in spark.range(4).select(rule.alias("c")).collect()] == ["low", "low", "even", "other"]
