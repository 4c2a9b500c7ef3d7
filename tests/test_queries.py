"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare_with_duckdb import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# Queries whose rule may rightly find nothing in the smallest tables.
MAY_BE_EMPTY = {"not_in_null_safe", "numeric_cross_references", "minimisation_changes",
                "bilingual_pairs", "translation_queue", "augmented_cap_diagnostics",
                "not_exists_joined", "catalog_widest", "near_duplicate_links", "evidence_overlap"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    problem, rows, _, _ = compare(spark, duck, SF_DIR, entry.queries()[name],
                                  entry.oracle_sql().get(name))
    assert problem is None, problem
    assert rows or name in MAY_BE_EMPTY


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_reference_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
