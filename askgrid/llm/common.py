"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.operators.bounded import materialise  # noqa: F401, used by the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def fresh(names, *taken) -> list[str]:
    """Names for working columns that clash with none of the given columns."""
    used = {name.lower() for columns in taken for name in columns}
    found = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def task_count(rows: DataFrame, column: str, bytes_per_task: int) -> int:
    """Tasks so that each holds about ``bytes_per_task`` of a text or binary column."""
    total = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // bytes_per_task))
