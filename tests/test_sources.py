import json

import pytest

from askgrid.session import probe
from askgrid.sources import artifacts, jdbc


def test_canonical_json_and_publish(spark, tmp_path):
    frame = spark.createDataFrame([(1, None, "س")], "b int, c string, a string")
    assert artifacts.canonical_json(frame).first().value == '{"a":"س","b":1,"c":null}'
    path = str(tmp_path / "out")
    artifacts.publish(frame, path)
    with pytest.raises(Exception):
        artifacts.publish(frame, path)
    with pytest.raises(Exception, match="finite"):
        artifacts.canonical_json(spark.createDataFrame([(float("inf"),)], "x double")).collect()
    assert json.loads(spark.read.text(path).first().value)["b"] == 1


def test_changed_rows(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n")], "id int, v string")
    assert sorted(r.id for r in artifacts.changed(before, after, ["id"]).collect()) == [2, 3, 4]


def test_count_gate(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    artifacts.require_counts(frame, "s", {"a": 2, "b": 1})
    with pytest.raises(ValueError):
        artifacts.require_counts(frame, "s", {"a": 2, "c": 1})


def test_jdbc_options():
    made = jdbc.options("h", "d", "sql", "u", "p")
    assert "applicationIntent=ReadOnly" in made["url"] and made["queryTimeout"] == "10"
    assert "integratedSecurity" in jdbc.options("h", "d", "windows")["url"]
    for bad in (("sql", None), ("other", "u")):
        with pytest.raises(ValueError):
            jdbc.options("h", "d", *bad)


def test_probe(spark):
    assert set(probe(spark)) == {"catalog", "database", "version"}
