"""URL rules found through their rarest literal token.

A rule is a regular expression over the normalised address (host in lower
case, then the path) together with the literal tokens that any address it
matches must contain. Rules are filed under the one of their tokens that is
rarest among the tokens of the pages. The tokens of an address fetch candidate
rules and only those are run as regular expressions. Rules without a literal
token are tried on every address.

Everything is DataFrame functions: one scan, one join with the rule index and
one aggregation per page, combined before its shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import ascii_lower
from askgrid.operators.bounded import broadcast_if_small, small_side

TOKEN = "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"  # what separates tokens
MAX_BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """One pattern. ``tokens`` must stand, delimited, in every address it matches.

    Among the rules that match, the highest ``priority`` decides, then the
    longest ``name``, then the first name and the first verdict in order.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    priority: int = 0


def host_path_rule(host: str, path: str, verdict: str, priority: int = 1) -> Rule:
    """A host, its subdomains, and paths that begin with ``path``."""
    words = [word for word in re.split(r"[^0-9A-Za-z\x80-\U0010FFFF]+", host) if word]
    # The last word of the path may go on in the address, unless something follows it.
    whole = re.findall(r"(?<![0-9A-Za-z\x80-\U0010FFFF])[0-9A-Za-z\x80-\U0010FFFF]+"
                       r"(?=[^0-9A-Za-z\x80-\U0010FFFF])", path)
    return Rule(host + path, verdict, f"(?s)^(?:[^/]*\\.)?{_quote(host)}{_quote(path)}",
                tuple(words + whole), priority)


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z\x80-\U0010FFFF])", r"\\\1", text)


# Block and allow rules by host and path, then what the pages themselves call for.
HOST_RULES = (
    host_path_rule("net", "/", "block"),
    host_path_rule("example.net", "/en/", "allow"),
    host_path_rule("example.com", "/de/", "block"),
    host_path_rule("org", "/fr/", "allow"),
)
PATTERN_RULES = (
    Rule("pharmacy spam", "block", r"(?s)^(?:[^/]*[.\-])?(?:cheap|discount|buy)-pills[.\-/]", ("pills",)),
    Rule("link farm", "block", r"(?s)^(?:[^/]*[.\-])?(?:spam|link)-farm[.\-/]", ("farm",)),
    Rule("betting", "block", r"(?s)^(?:[^/]*[.\-])?free-bets[.\-/]", ("free", "bets")),
    Rule("casino", "block", r"(?s)^(?:[^/]*[.\-])?casino[.\-/]", ("casino",)),
    Rule("adult", "block", r"(?s)^(?:[^/]*[.\-])?(?:xxx|porn)[.\-/]"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark, rules) -> DataFrame:
    rows = [(i, rule.name, rule.verdict, rule.pattern, list(rule.tokens), rule.priority)
            for i, rule in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, name string, verdict string, pattern string, "
                                       "tokens array<string>, priority int")


def rule_index(addresses: DataFrame, rules: DataFrame, limit: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Rules with the token each is filed under: its rarest one over all addresses.

    ``addresses`` has an array column ``tokens``. A rule without tokens is
    filed under the empty token, which every address carries.
    """
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    words = broadcast_if_small(wanted.select("token").distinct(), limit)
    seen = (addresses.select(F.explode("tokens").alias("token")).join(words, "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (wanted.join(seen, "token", "left").groupBy("rule_id")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least")))
    return (rules.join(rarest, "rule_id", "left")
            .select(F.coalesce("least.token", F.lit("")).alias("token"), "name", "verdict",
                    "pattern", "priority"))


def filter_urls(pages: DataFrame, rules=HOST_RULES + PATTERN_RULES, default: str = "allow",
                broadcast_limit: int = MAX_BROADCAST_RULES) -> DataFrame:
    """(page_id, url, host, path, matched, verdict, priority), one row per row of ``pages``.

    ``matched`` is the name of the deciding rule, null where none matches and
    the ``default`` verdict holds. Rules come as a sequence of :class:`Rule`.
    Repeated pages give repeated rows; an empty table gives none.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.concat(
        F.split(F.concat("host", "path"), TOKEN), F.array(F.lit(""))))
    rows = parts.select("page_id", "url", "host", "path", tokens.alias("tokens"))
    table = rule_table(spark, rules)
    index = small_side(rule_index(rows, table, broadcast_limit), len(rules) <= broadcast_limit)
    address = F.concat("host", "path")
    candidates = (rows.withColumn("row", F.monotonically_increasing_id())
                  .select("row", "page_id", "url", "host", "path",
                          F.explode("tokens").alias("token"))
                  .join(index, "token", "left")
                  .where(F.col("pattern").isNotNull() | (F.col("token") == "")))
    hit = F.when(F.col("pattern").isNotNull() & F.regexp_like(address, F.col("pattern")), F.struct(
        (-F.col("priority")).alias("p"), (-F.length("name")).alias("n"), F.col("name"), F.col("verdict")))
    best = (candidates.groupBy("row")
            .agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"),
                 F.first("host").alias("host"), F.first("path").alias("path"), F.min(hit).alias("best")))
    return best.select("page_id", "url", "host", "path", F.col("best.name").alias("matched"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
                       (-F.col("best.p")).alias("priority"))
