"""Text expressions: identifier words, tokens, captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed


def humanize(name: Column) -> Column:
    """A space before every capital letter except at the start."""
    return F.regexp_replace(name, "(?<!^)(?=[A-Z])", " ")


def raw_tokens(value: Column) -> Column:
    """Lower-case alphanumeric words, with camel case split."""
    split_lower = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")
    split_upper = F.regexp_replace(split_lower, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.lower(F.regexp_replace(split_upper, "[^A-Za-z0-9]+", " "))
    return F.filter(F.split(words, " "), lambda token: token != "")


def singular(token: Column) -> Column:
    """Small deterministic plural reduction."""
    size = F.length(token)
    return (F.when((size > 4) & token.endswith("ies"),
                   F.concat(token.substr(F.lit(1), size - 3), F.lit("y")))
            .when((size > 4) & token.endswith("ses"), token.substr(F.lit(1), size - 2))
            .when((size > 3) & token.endswith("s") & ~token.endswith("ss"),
                  token.substr(F.lit(1), size - 1))
            .otherwise(token))


def spelled(token: Column) -> Column:
    """Abbreviations written out."""
    full = token
    for short, word in fixed.ABBREVIATIONS.items():
        full = F.when(token == short, F.lit(word)).otherwise(full)
    return full


def stems(tokens: Column) -> Column:
    """Singular, spelled-out forms. Two steps, so that no step is evaluated twice per token."""
    return F.transform(F.transform(tokens, singular), spelled)


def identifier_tokens(value: Column) -> Column:
    """Tokens of an identifier: stemmed, structural tokens dropped."""
    return F.filter(stems(raw_tokens(value)),
                    lambda token: ~token.isin(*fixed.STRUCTURAL_TOKENS))


def distinct_identifier_tokens(value: Column) -> Column:
    """Distinct tokens of an identifier; repeated words are stemmed once."""
    return F.filter(F.array_distinct(stems(F.array_distinct(raw_tokens(value)))),
                    lambda token: ~token.isin(*fixed.STRUCTURAL_TOKENS))


def question_tokens(value: Column) -> Column:
    """Tokens of a question: as identifiers, stop words dropped too."""
    return F.filter(identifier_tokens(value),
                    lambda token: ~token.isin(*fixed.QUERY_STOP_WORDS))


def token_weight(token: Column) -> Column:
    weight = F.lit(1.0)
    for word, value in fixed.TOKEN_WEIGHTS.items():
        weight = F.when(token == word, F.lit(value)).otherwise(weight)
    return weight


def collapse(value: Column) -> Column:
    """Whitespace runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def shorten(value: Column, limit: int) -> Column:
    """At most ``limit`` characters, with an ellipsis when cut."""
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(F.rtrim(F.substring(value, 1, limit - 1)), F.lit("…")))
