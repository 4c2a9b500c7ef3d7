"""Key paths on small tables with nulls, orphans, repeated parents and composite keys."""

import pytest

from askgrid.operators.key_paths import Claim, verify_claim, verify_paths


def row_of(frame):
    (row,) = frame.collect()
    return row.rows, row.null_rows, row.orphan_rows, row.orphan_keys, row.ambiguous_keys, row.verdict


def test_counts(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a"), (9, "z"), (9, "z"), (1, None)], "k int, s string")
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "a")], "id int, t string")
    assert row_of(verify_claim(child, parent, Claim("c", ("k",), "p", ("id",)))) == (7, 1, 2, 1, 1, "orphans")
    both = Claim("c", ("k", "s"), "p", ("id", "t"))
    assert row_of(verify_claim(child, parent, both)) == (7, 2, 2, 1, 0, "orphans")
    assert row_of(verify_claim(child.where("k = 1"), parent, both)) == (3, 1, 0, 0, 0, "holds")
    assert row_of(verify_claim(child.where("k = 2"), parent, Claim("c", ("k",), "p", ("id",))))[-1] == "ambiguous"
    assert row_of(verify_claim(child.where("false"), parent, both)) == (0, 0, 0, 0, 0, "holds")
    assert row_of(verify_claim(child, parent.where("false"), both))[2] == 5


def test_paths_must_meet(spark):
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    tables = {"x": one, "y": one}
    good = Claim("x", ("a",), "y", ("a",))
    found = verify_paths(tables, {"p": [good, Claim("y", ("b",), "x", ("a",))], "q": [good]}).collect()
    assert {(r.path, r.hop, r.verdict, r.path_holds) for r in found} == {
        ("p", 1, "holds", False), ("p", 2, "orphans", False), ("q", 1, "holds", True)}
    with pytest.raises(ValueError, match="do not meet"):
        verify_paths(tables, {"p": [good, good]})
    with pytest.raises(ValueError, match="Unknown table"):
        verify_paths(tables, {"p": [Claim("x", ("a",), "n", ("a",))]})
    with pytest.raises(ValueError, match="as many"):
        verify_claim(one, one, Claim("x", ("a", "b"), "y", ("a",)))
