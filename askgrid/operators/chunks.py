"""Token-budgeted chunks and compact representations.

Packing depends on the order of records, so it folds over the record list of
one row. Rows are spread by Spark; the fold is a few lines of Python on an
Arrow batch. Tokens are pluggable: the default are words, and any function that
gives the token positions of a text works, such as a tokenizer's.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.operators.bounded import in_slices

WORD = re.compile(r"\S+")


def word_starts(text: str) -> list[int]:
    """Where each word of a text begins."""
    return [match.start() for match in WORD.finditer(text)]


def count_words(text: str) -> int:
    return len(word_starts(text))


def _cut_record(record: str, room: int, starts) -> list[str]:
    """Consecutive pieces of at most ``room`` tokens; joined they give the record.

    The tokens are located once and every ``room``-th one begins a piece. A
    piece whose own tokens are more, which a subword tokenizer may give, is cut
    again with less room.
    """
    if room < 1:
        raise ValueError("No room for a continuation")
    edges = [0, *starts(record)[room::room], len(record)]
    pieces = []
    for begin, end in zip(edges, edges[1:]):
        piece = record[begin:end]
        fits = len(starts(piece)) <= room
        pieces += [piece] if fits else _cut_record(piece, room - 1, starts)
    return pieces


def _pack(header: str, records, budget: int, starts):
    """Yield (first_record, last_record, part, parts, text).

    Every record is counted once; the sums guess where a chunk ends, and the
    assembled text moves that end by the few records its joints are worth.
    """
    def joined(parts):
        return "\n\n".join([header, *parts])

    def size(parts):
        return len(starts(joined(parts)))

    def fits(end):
        return size(records[first:end]) <= budget

    upto = [0, *accumulate(len(starts(record)) for record in records)]
    room = budget - size([])
    first = 0
    while first < len(records):
        end = max(first, bisect_right(upto, upto[first] + room) - 1)
        if fits(end):
            while end < len(records) and fits(end + 1):
                end += 1
        else:
            while end > first and not fits(end):
                end -= 1
        if end > first:
            yield first, end - 1, 1, 1, joined(records[first:end])
            first = end
            continue
        lead = f"Continuation: {first}\n"
        pieces = _cut_record(records[first], budget - size([lead]), starts)
        for part, piece in enumerate(pieces, start=1):
            yield first, first, part, len(pieces), joined([lead + piece])
        first += 1
    if not len(records):
        yield 0, -1, 1, 1, joined([])


CHUNK_SCHEMA = ("id string, chunk_no int, first_record int, last_record int, part int, parts int, "
                "token_count int, text string")
CHUNK_TYPES = [pa.string(), *[pa.int32()] * 6, pa.string()]


def pack_chunks(rows: DataFrame, budget: int = fixed.CHUNK_CONTENT_BUDGET,
                starts=word_starts) -> DataFrame:
    """Chunks of (id, header, records): greedy, in order, no overlap.

    ``starts`` gives the positions where the tokens of a text begin; the
    assembled text of a chunk is counted, not the sum over its parts.
    """
    def run(batches):
        for batch in in_slices(batches):
            out = []
            for key, header, records in zip(*(batch.column(name).to_pylist() for name in ("id", "header", "records"))):
                items = [] if records is None else records
                for number, (first, last, part, parts, text) in enumerate(
                        _pack(header, items, budget, starts), start=1):
                    out.append((key, number, first, last, part, parts, len(starts(text)), text))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*out), CHUNK_TYPES)],
                    names=[item.split()[0] for item in CHUNK_SCHEMA.split(", ")])

    return rows.select(F.col("id").cast("string").alias("id"), "header", "records").mapInArrow(
        run, CHUNK_SCHEMA)


def altered_texts(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, problem): chunks that are not their records under their header.

    The pieces of a split record must give that record again, so a lost or
    altered piece shows too; such a record is listed once.
    """
    given = rows.select(F.col("id").cast("string").alias("id"), "header",
                        F.coalesce("records", F.array().cast("array<string>")).alias("records"))
    lead = F.format_string("Continuation: %d\n", "first_record")
    held = F.slice("records", F.col("first_record") + 1,
                   F.greatest(F.col("last_record") - F.col("first_record") + 1, F.lit(0)))
    below = F.concat("header", F.lit("\n\n"))

    def differ(made, expected):
        return ~F.sha2(made, 256).eqNullSafe(F.sha2(expected, 256))

    whole = chunks.where("parts = 1").join(given, "id").where(
        differ(F.col("text"), F.array_join(F.concat(F.array("header"), held), "\n\n"))
        & differ(F.col("text"), F.concat(below, lead, F.coalesce(F.get(held, F.lit(0)), F.lit("")))))
    pieces = (chunks.where("parts > 1").groupBy("id", "first_record")
              .agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("pieces")).join(given, "id"))
    skipped = F.length(F.concat(below, lead)) + 1
    again = F.array_join(F.transform("pieces", lambda piece: F.substr(piece["text"], skipped)), "")
    split = pieces.where(differ(again, F.get("records", F.col("first_record"))))
    return whole.select("id", F.lit("text differs").alias("problem")).unionByName(
        split.select("id", F.lit("text differs").alias("problem")))


def chunk_violations(rows: DataFrame, chunks: DataFrame,
                     budget: int = fixed.CHUNK_CONTENT_BUDGET) -> DataFrame:
    """(id, problem): records no chunk represents, chunks over the budget, texts that are not their records."""
    wanted = rows.select(F.col("id").cast("string").alias("id"),
                         F.posexplode("records").alias("record", "_text")).drop("_text")
    held = chunks.where("last_record >= first_record").select(
        "id", F.explode(F.sequence("first_record", "last_record")).alias("record"))
    missing = wanted.join(held, ["id", "record"], "left_anti").select(
        "id", F.lit("record not represented").alias("problem"))
    over = chunks.where(F.col("token_count") > budget).select(
        "id", F.lit("budget exceeded").alias("problem"))
    return missing.unionByName(over).unionByName(altered_texts(rows, chunks))


def fitting(items: Column, prefix_tokens: int, budget: int) -> Column:
    """Items kept greedily in order while the words fit; later items may still fit."""
    start = F.struct(F.lit(prefix_tokens).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(state, item):
        size = F.size(F.regexp_extract_all(item, F.lit(r"\S+"), F.lit(0)))
        fits = state["used"] + size <= budget
        return F.struct(F.when(fits, state["used"] + size).otherwise(state["used"]).alias("used"),
                        F.when(fits, F.concat(state["kept"], F.array(item)))
                        .otherwise(state["kept"]).alias("kept"))

    return F.aggregate(items, start, step, lambda state: state["kept"])


def normalized_unique(values: Column, excluded: Column) -> Column:
    """Whitespace-collapsed, case-insensitively distinct captions in folded order, first spelling kept."""
    collapsed = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))),
                         lambda v: v != "")
    keyed = F.array_sort(F.transform(collapsed, lambda v, i: F.struct(
        F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))
    banned = F.transform(excluded, F.lower)
    start = F.array().cast("array<struct<k:string,i:int,v:string>>")
    distinct = F.aggregate(keyed, start, lambda kept, item: F.when(
        F.array_contains(F.transform(kept, lambda x: x["k"]), item["k"])
        | F.array_contains(banned, item["k"]), kept).otherwise(F.concat(kept, F.array(item))))
    return F.transform(distinct, lambda item: item["v"])


def evenly_spaced(n: int, m: int) -> list[int]:
    if m < 2:
        return [0][:m]
    return [math.floor(i * (n - 1) / (m - 1)) for i in range(m)]


def spaced_columns(rows: DataFrame, budget: int, count=count_words) -> DataFrame:
    """(id, columns, chosen, total): the largest evenly spaced subset whose words fit.

    ``rows``: (id, entries array<string>).
    """
    def run(batches):
        for batch in batches:
            out = []
            for key, entries in zip(batch["id"], batch["entries"]):
                items = [] if entries is None else list(entries)
                sizes = [count(item) for item in items]
                for m in range(len(items), -1, -1):
                    places = evenly_spaced(len(items), m)
                    if sum(sizes[i] for i in places) <= budget:
                        break
                out.append((key, "; ".join(items[i] for i in places) or "None", len(places), len(items)))
            yield pd.DataFrame(out, columns=["id", "columns", "chosen", "total"])

    return rows.select("id", "entries").mapInPandas(
        run, "id string, columns string, chosen int, total int")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def retained_end(text: Column, tokens: int) -> Column:
    """Characters covered by the first ``tokens`` words."""
    return F.length(F.regexp_extract(text, r"^(?:\s*\S+){0,%d}" % tokens, 0))
