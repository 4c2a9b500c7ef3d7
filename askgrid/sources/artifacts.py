"""Published artefacts: canonical JSON, hashes, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(frame: DataFrame) -> DataFrame:
    """One JSON object per row with sorted keys; numbers must be finite."""
    kinds = dict(frame.dtypes)
    cells = []
    for name in sorted(frame.columns):
        value = F.col(f"`{name}`")
        if kinds[name] in ("double", "float"):
            value = F.when(F.isnan(value) | (F.abs(value) == float("inf")),
                           F.raise_error(F.lit("Value is not finite"))).otherwise(value)
        cells.append(value.alias(name))
    return frame.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def publish(frame: DataFrame, path: str) -> None:
    """Write canonical JSON lines; existing output is never replaced."""
    canonical_json(frame).write.mode("errorifexists").text(path)


def digests(frame: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of the canonical form of each row."""
    rest = [name for name in frame.columns if name not in keys]
    return frame.select(*keys, F.sha2(F.to_json(
        F.struct(*sorted(rest)), {"ignoreNullFields": "false"}), 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose protected content differs, appeared or disappeared."""
    left = digests(before, keys).withColumnRenamed("sha256", "before_sha256")
    right = digests(after, keys).withColumnRenamed("sha256", "after_sha256")
    return left.join(right, keys, "full").where("NOT before_sha256 <=> after_sha256")


def require_counts(frame: DataFrame, key: str, expected: dict[str, int]) -> None:
    """Gate: every source must hold exactly the expected number of rows."""
    found = {row[key]: row["n"] for row in frame.where(F.col(key).isin(*expected)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    wrong = {name: (count, found.get(name, 0)) for name, count in expected.items()
             if found.get(name, 0) != count}
    if wrong:
        raise ValueError(f"Unexpected row counts: {wrong}")
