"""Claimed key paths checked against the rows of the tables.

A claim says that every non-null key of a child table is a key of a parent
table. Keys may be composite. Child keys are counted before anything is
shuffled for the join, so a very common key is one row from then on, and the
parent side is its distinct keys with their number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Claim:
    """One hop: ``child.columns`` point to ``parent.keys``, column by column."""

    child: str
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...]

    @property
    def text(self) -> str:
        return f"{self.child}({', '.join(self.columns)}) -> {self.parent}({', '.join(self.keys)})"


def verify_claim(child: DataFrame, parent: DataFrame, claim: Claim) -> DataFrame:
    """One row: (claim, rows, null_rows, orphan_rows, orphan_keys, ambiguous_keys, verdict).

    A row with a null in any key column points nowhere and is no orphan. Of the
    keys that rows point to, ``ambiguous_keys`` are several rows of the parent.
    The verdict is ``holds``, ``orphans`` or ``ambiguous``; empty tables hold.
    """
    if len(claim.columns) != len(claim.keys) or not claim.keys:
        raise ValueError("A claim needs as many child columns as keys")
    names = [f"k{n}" for n in range(len(claim.keys))]
    pointing = (child.select(*[F.col(column).alias(name) for column, name in zip(claim.columns, names)])
                .groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    keys = (parent.select(*[F.col(key).alias(name) for key, name in zip(claim.keys, names)])
            .dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("found")))
    empty = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in names])
    orphan = ~empty & F.col("found").isNull()

    def total(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")

    counted = pointing.join(keys, names, "left").agg(
        total(F.lit(True), F.col("n")).alias("rows"), total(empty, F.col("n")).alias("null_rows"),
        total(orphan, F.col("n")).alias("orphan_rows"), total(orphan, F.lit(1)).alias("orphan_keys"),
        total(F.col("found") > 1, F.lit(1)).alias("ambiguous_keys"))
    return counted.select(
        F.lit(claim.text).alias("claim"), "*",
        F.when(F.col("orphan_rows") > 0, "orphans").when(F.col("ambiguous_keys") > 0, "ambiguous")
        .otherwise("holds").alias("verdict"))


def verify_paths(tables: dict[str, DataFrame], paths: dict[str, list[Claim]]) -> DataFrame:
    """The hops of every named path, in order: (path, hop, claim, …, verdict, path_holds).

    Consecutive hops must meet: the parent of one is the child of the next. A
    path holds when all its hops do. A hop that several paths share is counted
    once for each.
    """
    hops = []
    for path, claims in paths.items():
        for one, two in zip(claims, claims[1:]):
            if one.parent != two.child:
                raise ValueError(f"The hops of {path} do not meet")
        for number, claim in enumerate(claims, 1):
            unknown = [name for name in (claim.child, claim.parent) if name not in tables]
            if unknown:
                raise ValueError(f"Unknown table: {unknown[0]}")
            found = verify_claim(tables[claim.child], tables[claim.parent], claim)
            hops.append(found.select(F.lit(path).alias("path"), F.lit(number).alias("hop"), "*"))
    every = reduce(DataFrame.unionByName, hops)
    holds = every.groupBy("path").agg(F.bool_and(F.col("verdict") == "holds").alias("path_holds"))
    return every.join(holds, "path")
