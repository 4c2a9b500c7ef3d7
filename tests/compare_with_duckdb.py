"""Run registered queries next to their DuckDB SQL and compare whole results.

usage: python tests/compare_with_duckdb.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TYPE_NAMES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(item) for item in value) + "]"
    return repr(value)


def connect(sf_dir):
    import duckdb

    from askgrid.sources.tables import TABLE_NAMES
    connection = duckdb.connect()
    for name in TABLE_NAMES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def compare(spark, connection, sf_dir, build, sql):
    """Return (problem or None, row count, seconds in Spark, seconds in DuckDB)."""
    started = time.time()
    frame = build(spark, sf_dir)
    rows = frame.collect()
    spark_seconds = time.time() - started
    if sql is None:
        return None, len(rows), spark_seconds, None
    started = time.time()
    cursor = connection.execute(sql)
    names = [item[0] for item in cursor.description]
    types = {item[0]: str(item[1]) for item in cursor.description}
    expected = cursor.fetchall()
    duck_seconds = time.time() - started
    problem = None
    if sorted(names) != sorted(frame.columns):
        problem = f"columns {sorted(frame.columns)} vs {sorted(names)}"
    else:
        order = sorted(names)
        left = Counter(tuple(plain(row[name]) for name in order) for row in rows)
        positions = [names.index(name) for name in order]
        right = Counter(tuple(plain(row[i]) for i in positions) for row in expected)
        if left != right:
            missing = list((right - left).items())[:3]
            extra = list((left - right).items())[:3]
            problem = (f"rows {sum(left.values())} vs {sum(right.values())}; columns {order}\n"
                       f"  only duckdb {sum((right - left).values())}: {str(missing)[:1500]}\n"
                       f"  only spark {sum((left - right).values())}: {str(extra)[:1500]}")
        wrong = [(name, kind, types[name]) for name, kind in frame.dtypes
                 if TYPE_NAMES.get(kind, kind) != types[name]]
        if wrong:
            problem = (problem or "") + f" types {wrong}"
    return problem, len(rows), spark_seconds, duck_seconds


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()

    import __spark_entry__ as entry
    from askgrid.session import build_session
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(options.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [name for name in queries
             if not options.names or any(name.startswith(part) for part in options.names)]
    failed = []
    for name in names:
        try:
            problem, count, spark_seconds, duck_seconds = compare(
                spark, connection, options.sf, queries[name], oracles.get(name))
        except Exception as exc:
            problem, count, spark_seconds, duck_seconds = (
                "".join(traceback.format_exception_only(exc))[:1500], 0, 0.0, None)
        mark = "ok " if problem is None and count else "EMPTY" if problem is None else "BAD"
        if problem is not None or count == 0:
            failed.append(name)
        oracle = "no sql" if duck_seconds is None else f"duck {duck_seconds:6.2f}s"
        print(f"{mark:5} {name:34} rows {count:7} spark {spark_seconds:6.2f}s {oracle}", flush=True)
        if problem:
            print("     ", problem, flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} good; bad: {failed}")


if __name__ == "__main__":
    main()
