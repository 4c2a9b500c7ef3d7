"""Benchmark decontamination by n-gram windows.

The windows of the benchmark items (``n`` consecutive words; an item with
fewer is one window) are a broadcast hash set. The word windows of every
document are hashed at every position and probed against the set; a probe
that finds an entry is verified word by word. A document word inside a
verified window is hit. Documents can be dropped, or their hit spans removed.

The benchmark is counted before it is broadcast; beyond the limit the same
join runs shuffled. Each document also probes the empty window at its end,
which the set holds once, so documents without hits come out of the same scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import ascii_lower, fresh, materialise
from askgrid.operators.bounded import broadcast_if_small

WINDOW = 13
MIN_SHARE_DIVISOR = 20
MAX_BROADCAST_WINDOWS = 2_000_000
MAX_BROADCAST_IDS = 500_000
STRETCH = 512
WORD = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"


def words_of(text: Column) -> Column:
    """Words of a text in lower case (A-Z); none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(words, item_ids): every distinct window and the items it stands in."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))))
    return (words.select("item_id", "words", starts.alias("at"))
            .select("item_id", F.slice("words", F.col("at"), F.lit(n)).alias("words"))
            .groupBy("words").agg(F.collect_set("item_id").alias("item_ids")))


def find_hits(docs: DataFrame, items: DataFrame, n: int = WINDOW,
              limit: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, item_ids, spans), one row per row of ``docs``.

    ``spans`` are the merged hit ranges as (first word, words), counted from 0.
    ``text_key`` hashes the text, to join the result back to its document.
    A document or item without words, or with a null text, has no hits; items
    with a null id count as occurring but are not listed.
    """
    windows = benchmark_windows(items, n)
    lengths = sorted(row[0] for row in windows.select(F.size("words")).distinct().collect())
    index = windows.select("words", "item_ids").unionByName(
        windows.sparkSession.range(1).select(
            F.array().cast("array<string>").alias("words"),
            F.array().cast(windows.schema["item_ids"].dataType).alias("item_ids")))
    index = broadcast_if_small(index.select(
        F.xxhash64("words").alias("key"), F.col("words").alias("window"), "item_ids"), limit)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    # Stretches of a text, overlapping by a window; then its positions, one past the end included.
    longest = max(lengths, default=1)
    stretches = rows.select("row", "doc_id", "text_key", F.size("words").alias("n_words"), F.inline(F.transform(
        F.sequence(F.lit(0), F.size("words"), F.lit(STRETCH)), lambda base: F.struct(
            base.alias("base"), F.slice("words", base + 1, F.lit(STRETCH + longest - 1)).alias("part")))))
    at = stretches.select("row", "doc_id", "text_key", "n_words", "base", "part", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(STRETCH), F.col("n_words") + 1 - F.col("base")))).alias("at"))
    slices = [F.slice("part", F.col("at"), F.lit(length)) for length in lengths] or [
        F.array().cast("array<string>")]
    window = slices[0] if len(slices) == 1 else F.explode(F.array_distinct(F.array(*slices)))
    probes = at.select("row", "doc_id", "text_key", "n_words",
                       (F.col("base") + F.col("at") - 1).alias("begin"), window.alias("own"))
    found = (probes.withColumn("key", F.xxhash64("own")).join(index, "key")
             .where(F.col("own") == F.col("window"))
             .where((F.size("window") > 0) | (F.col("begin") == F.col("n_words")))
             .select("row", "doc_id", "text_key", "n_words", "begin",
                     F.size("window").alias("length"), "item_ids"))
    grouped = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("length") > 0, F.struct(
            "begin", (F.col("begin") + F.col("length")).alias("end"))))).alias("ranges"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    return (grouped.withColumn("spans", merged("ranges"))
            .select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce(F.aggregate("spans", F.lit(0), lambda total, span: total + span["words"]),
                               F.lit(0)).cast("long").alias("n_hit"),
                    "item_ids", "spans"))


def merged(ranges: str) -> Column:
    """Sorted (begin, end) ranges joined where they touch, as (begin, words)."""
    kind = "array<struct<begin:int,end:int>>"

    def add(done: Column, item: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"),
                          F.greatest(last["end"], item["end"]).alias("end"))
        return (F.when(F.size(done) == 0, F.array(item))
                .when(last["end"] >= item["begin"], F.concat(
                    F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined)))
                .otherwise(F.concat(done, F.array(item))).cast(kind))

    return F.transform(F.aggregate(ranges, F.array().cast(kind), add), lambda item: F.struct(
        item["begin"].alias("begin"), (item["end"] - item["begin"]).alias("words")))


def is_contaminated(n_hit: Column, n_words: Column, divisor: int = MIN_SHARE_DIVISOR) -> Column:
    """Hit words are at least one in ``divisor``."""
    return (n_hit > 0) & (n_hit * divisor >= n_words)


def drop_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW,
                   divisor: int = MIN_SHARE_DIVISOR) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay, whatever their names.

    Rows with a null text or no words stay. Rows are told apart by doc_id (null
    included) and text, so repeated rows stay or go together. Without items, or
    without rows, nothing is dropped.
    """
    bad_id, bad_key = fresh(["bad_id", "bad_key"], docs.columns)
    bad = materialise(
        find_hits(docs, items, n).where(is_contaminated(F.col("n_hit"), F.col("n_words"), divisor))
        .select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct(),
        "contaminated")
    return docs.join(broadcast_if_small(bad, MAX_BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col(bad_id))
                     & (F.xxhash64("text") == F.col(bad_key)), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``, with what stands before each of them.

    Text without hits stays as it is, character by character; so do null texts.
    Repeated rows are cut alike, and no row is added or lost. Columns of
    ``docs`` may have any names.
    """
    key, hits, parts, hit_id, hit_key = fresh(["text_key", "hits", "parts", "hit_id", "hit_key"], docs.columns)
    found = (find_hits(docs, items, n).where("n_hit > 0")
             .select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key),
                     F.col("spans").alias(hits)).dropDuplicates([hit_id, hit_key]))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(hit_id))
                        & (F.col(key) == F.col(hit_key)), "left")
    # Each part: one word with what stands before it; the last one may be without a word.
    pieces = F.regexp_extract_all("text", F.lit(
        r"(?s)[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]*[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
        r"|[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+$"), F.lit(0))
    clean = F.array_join(F.filter(parts, lambda part, at: ~F.exists(hits, lambda span: (
        (at >= span["begin"]) & (at < span["begin"] + span["words"])))), "")
    return (joined.withColumn(parts, F.when(F.col(hits).isNotNull(), pieces))
            .withColumn("text", F.when(F.col(hits).isNotNull(), clean).otherwise(F.col("text")))
            .select(*docs.columns))
