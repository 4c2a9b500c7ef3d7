"""Unicode normal form, the one text step Spark SQL has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda value: None if value is None else unicodedata.normalize("NFKC", value))


@F.pandas_udf(StringType())
def nfkc_folded(values: pd.Series) -> pd.Series:
    return values.map(lambda value: None if value is None
                      else unicodedata.normalize("NFKC", value).casefold())


def normalized(value: Column) -> Column:
    """NFKC with whitespace runs collapsed."""
    return F.trim(F.regexp_replace(nfkc(F.coalesce(value, F.lit(""))), r"(?U)\s+", " "))


def joined_form(value: Column) -> Column:
    """Normal form for selection: zero-width non-joiners count as spaces, letter case does not count."""
    spaced = F.replace(nfkc_folded(F.coalesce(value, F.lit(""))), F.lit("\u200c"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def folded_words(value: Column) -> Column:
    """Distinct words of the NFKC, case-folded text."""
    words = F.regexp_extract_all(nfkc_folded(F.coalesce(value, F.lit(""))),
                                 F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(words)
