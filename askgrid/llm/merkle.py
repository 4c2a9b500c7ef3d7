"""Merkle fingerprints of documents.

The tree of a text: the root over its sections, a section over eight
paragraphs (lines), a paragraph over runs of four words. The first 64 code
points are a branch of their own with leaves of eight code points, so short
texts have branches too. A fingerprint is

    <root> / <leaves of the head> / <section digest> : <leaves> / ...

The root is SHA-256 over the branch digests, which are SHA-256 over paragraph
digests, so equal roots mean equal texts. Leaves are 32-bit hashes; they show
where two texts with different roots differ. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.common import fresh

HEAD = 64
HEAD_LEAF = 8
SECTION = 8
RUN = r"(?s)\s*+(?:\S++\s*+){1,4}+|\s++"
CELLS_PER_BUCKET = 16
MAX_CELLS = 1 << 18
BUCKET_BYTES = 4 << 20


def _leaves(pieces: Column) -> Column:
    return F.transform(pieces, lambda piece: F.substr(
        F.hex(F.xxhash64(piece).bitwiseOR(F.lit(-(1 << 63)).cast("long"))), F.lit(9), F.lit(8)))


def add_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of a text column; a null text counts as empty."""
    first, branches = fresh(["head", "sections"], rows.columns, [name])
    whole = F.coalesce(F.col(text), F.lit(""))
    rest = F.substring(whole, HEAD + 1, 1 << 30)
    head = F.substring(whole, 1, HEAD)
    paragraphs = F.split(rest, "\n", -1)
    sections = F.transform(paragraphs, lambda line: F.struct(
        F.sha2(line, 256).alias("digest"),
        F.array_join(_leaves(F.regexp_extract_all(line, F.lit(RUN), F.lit(0))), "").alias("leaves")))
    grouped = (rows.withColumn(first, head).withColumn(branches, sections)
               .withColumn(branches, F.transform(
                   F.sequence(F.lit(0), F.greatest((F.size(branches) - 1) / SECTION, F.lit(0)).cast("int")),
                   lambda k: F.slice(branches, k * SECTION + 1, F.lit(SECTION))))
               .withColumn(branches, F.transform(branches, lambda section: F.struct(
                   F.sha2(F.array_join(F.transform(section, lambda line: line["digest"]), ""), 256).alias("digest"),
                   F.array_join(F.transform(section, lambda line: line["leaves"]), "").alias("leaves")))))
    root = F.sha2(F.concat(F.sha2(F.col(first), 256), F.array_join(
        F.transform(branches, lambda section: section["digest"]), "")), 256)
    head_leaves = F.array_join(_leaves(F.regexp_extract_all(
        F.col(first), F.lit("(?s).{1,%d}" % HEAD_LEAF), F.lit(0))), "")
    body = F.array_join(F.transform(branches, lambda section: F.concat(
        F.substring(section["digest"], 1, 16), F.lit(":"), section["leaves"])), "/")
    return (grouped.withColumn(name, F.concat(root, F.lit("/"), head_leaves, F.lit("/"), body))
            .drop(first, branches))


def branches_of(fingerprint: Column) -> Column:
    """The branches below the root: the leaves of the head, then ``digest:leaves`` of every section."""
    return F.split(F.substring(fingerprint, 66, 1 << 30), "/", -1)


def leaf_list(branches: Column) -> Column:
    """All leaves of branches, upper-case hex; digests are lower-case."""
    return F.regexp_extract_all(F.array_join(F.transform(
        branches, lambda branch: F.substring_index(branch, ":", -1)), ""), F.lit("[0-9A-F]{8}"), F.lit(0))


def likeness(one: Column, two: Column) -> Column:
    """Dice share of leaves of two fingerprints, found from the root down.

    Equal roots give 1 and end the comparison. A branch that the other tree has
    too, at any place, is settled: all its leaves are common, none is looked at.
    Only leaves below branches that one tree alone has are compared, as sets.
    Repeated branches count once; trees without leaves have likeness 0.
    """
    first, second = branches_of(one), branches_of(two)
    settled = F.aggregate(F.array_intersect(first, second), F.lit(0), lambda total, branch: total + (
        F.length(F.substring_index(branch, ":", -1)) / 8).cast("int"))
    mine, other = (F.array_distinct(leaf_list(F.array_except(*pair))) for pair in ((first, second), (second, first)))
    shared = settled + F.size(F.array_intersect(mine, other))
    total = 2 * settled + F.size(mine) + F.size(other)
    return (F.when(F.substring(one, 1, 64) == F.substring(two, 1, 64), F.lit(1.0))
            .when(total == 0, F.lit(0.0)).otherwise(2.0 * shared / total))


def changed_branches(one: Column, two: Column) -> Column:
    """Positions of the branches that differ: 0 is the head, then the sections; none for equal roots."""
    same = F.zip_with(branches_of(one), branches_of(two), lambda a, b: a.eqNullSafe(b))
    return F.when(F.substring(one, 1, 64) == F.substring(two, 1, 64), F.array().cast("array<int>")).otherwise(
        F.filter(F.transform(same, lambda equal, at: F.when(~equal, at.cast("int"))),
                 lambda at: at.isNotNull()))


def with_next_text(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, next_text): the next document in descending doc_id, after the last the first.

    Ids are laid on a grid of equal steps, sixteen for each bucket that the
    bytes call for and at most ``MAX_CELLS``; neighbouring steps join to buckets of about ``bucket_bytes``, and the first row of a bucket is
    also sent to the bucket before it. So the order needs one shuffle of the
    texts, and the window spills; a bucket holds more than its bytes only where
    one step does (a much repeated id, null ids, ids far from all others). Nulls (as
    ids last, as texts empty) and repeated ids (ordered by a hash of the text)
    are rows of their own; a single row follows itself.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("k"))
    least, most, size = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long"),
                                 F.sum(F.octet_length("text"))).first()
    cells = min(MAX_CELLS, CELLS_PER_BUCKET * (1 + (size or 0) // bucket_bytes))
    span = float((most or 0) - (least or 0)) + 1.0
    cell = F.when(F.col("k") == lowest, F.lit(-1)).otherwise(
        F.floor((F.col("k").cast("double") - float(least or 0)) / span * cells)).cast("int")
    sized = rows.withColumn("cell", cell)
    grid = (sized.groupBy("cell").agg(F.max("k").alias("top"), F.sum(F.octet_length("text")).alias("bytes"))
            # At most ``cells`` + 1 rows from here on, and as many are broadcast.
            .withColumn("bucket", F.floor(F.coalesce(F.sum("bytes").over(
                Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / bucket_bytes)))
    tops = grid.groupBy("bucket").agg(F.max("top").alias("head"))
    order = Window.orderBy("bucket")
    tops = tops.withColumn("to", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(
        Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    placed = grid.join(tops, "bucket").select("cell", "bucket", "head", "to")
    dealt = (sized.join(F.broadcast(placed), "cell")
             .withColumn("place", F.explode(F.when(F.col("k") == F.col("head"), F.array(
                 F.struct(F.col("bucket"), F.lit(0).alias("copy")),
                 F.struct(F.col("to").alias("bucket"), F.lit(1).alias("copy")))).otherwise(
                     F.array(F.struct(F.col("bucket"), F.lit(0).alias("copy"))))))
             .select("doc_id", "text", "k", "place.bucket", "place.copy"))
    inside = Window.partitionBy("bucket").orderBy("copy", F.desc("k"), F.xxhash64("text"))
    return (dealt.withColumn("next_text", F.lead("text").over(inside))
            .where("copy = 0").select("doc_id", "text", "next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    Edited: the last third (floor) of the code points replaced by the first as
    many, or all, of the next document's. Returns (doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited, near_next, changed_branches);
    the last one lists the branches that the edit changed. Null texts count as
    empty, repeated rows stay rows of their own, other columns are not read.
    """
    rows = (with_next_text(docs).withColumn("n_chars", F.length("text"))
            .withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
            .withColumn("edited", F.concat(
                F.substr("text", F.lit(1), F.col("n_chars") - F.col("cut")),
                F.substr("next_text", F.lit(1), F.col("cut")))))
    for text, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next")):
        rows = add_fingerprint(rows, text, name)
    kept = F.col("fingerprint")
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "fingerprint",
                       "edited_fingerprint", likeness(kept, F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(kept, F.col("next")).alias("near_next"),
                       changed_branches(kept, F.col("edited_fingerprint")).alias("changed_branches"))
