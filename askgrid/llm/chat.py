"""Preference formatting of chosen and rejected conversations.

The longest common prefix of the two turn lists is rendered once as the
prompt. What follows in either conversation is rendered as its completion,
with the character ranges on which a model is to be trained: what assistants
say, up to and including the end mark. DataFrame functions only.

A conversation is one record of the result, so it is gathered by its id;
repeated rows of a turn are combined before that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
END = "<|end|>\n"


def _field(value: Column, default: str) -> Column:
    """Text that cannot be read as a mark of the template."""
    return F.replace(F.coalesce(value, F.lit(default)), F.lit("<|"), F.lit("< |"))


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _field(turn["role"], "unknown"), F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(_field(turn["text"], ""), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda turn: F.concat(head(turn), body(turn))), "")


def trained_ranges(turns: Column) -> Column:
    """Character ranges [begin, end) of the rendered turns that carry loss."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("ranges"))

    def add(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(head(turn))
        end = begin + F.length(body(turn))
        item = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == TRAINED_ROLE, F.concat(done["ranges"], item))
                        .otherwise(done["ranges"]).alias("ranges"))

    return F.aggregate(turns, start, add, lambda done: done["ranges"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Turns at the beginning that are equal in both lists."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    equal = F.zip_with(F.slice(chosen, F.lit(1), shorter), F.slice(rejected, F.lit(1), shorter),
                       lambda one, two: one["role"].eqNullSafe(two["role"])
                       & one["text"].eqNullSafe(two["text"]))
    first_other = F.array_position(equal, False)
    return F.when(first_other == 0, shorter).otherwise(first_other - 1).cast("int")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns in order (turn, role, text); equal rows count once.

    Rows without a conv_id belong to no conversation.
    """
    return (turns.where("conv_id IS NOT NULL").groupBy("conv_id")
            .agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
            .select("conv_id", F.transform("turns", lambda turn: F.struct(
                turn["role"].alias("role"), turn["text"].alias("text"))).alias("turns")))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions of (pair_id, chosen, rejected).

    ``chosen`` and ``rejected`` are arrays of (role, text); a null list counts
    as empty, a null role is rendered as ``unknown`` and a null text as empty.
    Returns (pair_id, prompt_turns, prompt, chosen, chosen_ranges, rejected,
    rejected_ranges). Equal conversations give two empty completions.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    lists = pairs.select("pair_id", *[F.coalesce(F.transform(name, lambda turn: F.struct(
        turn["role"].alias("role"), turn["text"].alias("text"))), empty).alias(name)
        for name in ("chosen", "rejected")])
    split = lists.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))

    def rest(name):
        return F.slice(name, F.col("n") + 1, F.size(name))

    parts = split.select("pair_id", F.col("n").alias("prompt_turns"),
                         F.slice("chosen", F.lit(1), F.col("n")).alias("p"),
                         rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select("pair_id", "prompt_turns", rendered(F.col("p")).alias("prompt"),
                        rendered(F.col("c")).alias("chosen"), trained_ranges(F.col("c")).alias("chosen_ranges"),
                        rendered(F.col("r")).alias("rejected"), trained_ranges(F.col("r")).alias("rejected_ranges"))


def swapped_reply_pairs(turns: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations.

    Chosen is the conversation itself. Rejected are its turns before the last
    reply, answered with the last reply of its neighbour (2k and 2k + 1 are
    neighbours); without a neighbour, or where that never replies, the answer
    is empty. A conversation without replies is rejected as it stands.
    """
    all_ = conversations(turns)
    is_reply = F.transform("turns", lambda turn: F.coalesce(turn["role"] == TRAINED_ROLE, F.lit(False)))
    last = F.when(F.array_contains(is_reply, True),
                  F.size("turns") - F.array_position(F.reverse(is_reply), True).cast("int")).otherwise(-1)
    known = all_.withColumn("last", last)
    replies = known.where("last >= 0").select(
        F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"),
        F.get("turns", F.col("last"))["text"].alias("reply"))
    answer = F.array(F.struct(F.lit(TRAINED_ROLE).alias("role"),
                              F.coalesce("reply", F.lit("")).alias("text")))
    return known.join(replies, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.when(F.col("last") < 0, F.col("turns")).otherwise(
            F.concat(F.slice("turns", F.lit(1), F.greatest("last", F.lit(0))), answer)).alias("rejected"))
