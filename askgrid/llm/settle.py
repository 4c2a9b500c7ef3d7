"""Linking the nodes of overlapping buckets without pairing large groups with themselves.

Nodes that share a bucket are candidates. What is wanted are enough links that
the components equal those of all pairs of candidates:

1. Star rounds: every node of a bucket that is not in the bucket's largest
   component is paired with one node inside that component and one outside. In
   the first round the star is the node whose buckets hold most nodes, later
   ones follow a hash. Pairs are verified, components are merged, and buckets
   whose nodes are all in one component are settled.
   The rounds end early when few nodes are outside, for each round is many
   small jobs, whose plans and tasks the driver holds.
2. What is left is paired completely: a bucket's nodes are dealt to blocks of
   bounded rows and bytes, each node once; only nodes outside of the largest
   component are copied to all blocks of their bucket, so rows are n + outside x
   blocks. A task holds one block and streams the copies past it.

Components are merged on labels: a round's links connect the labels of their
ends, and only the graph of labels is contracted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import materialise
from askgrid.operators.components import connected_components

ROUNDS = 5
PAIRS_PER_ROW = 64
BLOCK_ROWS = 512
BLOCK_BYTES = 16 << 20


def distinct_buckets(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, node, n, weight) of buckets with several nodes; of equal buckets the least one, with their number."""
    rows = materialise(rows.select("bucket", "node"), f"{name}-members")
    sizes = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("one"),
        F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 20)).alias("two")).where("n > 1")
    once = sizes.groupBy("n", "one", "two").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("weight"))
    return materialise(rows.join(once.select("bucket", "n", "weight"), "bucket"), f"{name}-buckets")


def open_buckets(buckets: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(bucket, node, n, weight, label, major) of buckets with several labels; ``major`` is the commonest one.

    After the first round pairs of nodes are done. Before it every node is its
    own label and ``major`` is null.
    """
    if labels is None:
        return (buckets.withColumn("label", F.col("node"))
                .withColumn("major", F.lit(None).cast("long")))
    labelled = (buckets.where("n > 2").join(labels, "node", "left")
                .withColumn("label", F.coalesce("label", "node")))
    counts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    majors = (counts.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("best"),
                                           F.count(F.lit(1)).alias("kinds"))
              .where("kinds > 1").select("bucket", F.col("best.label").alias("major")))
    return labelled.join(majors, "bucket")


def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): nodes outside of the largest component of their bucket, with a star in it and one outside."""
    if turn:
        ranked = rows.withColumn("rank", F.xxhash64("node", F.lit(turn)))
    else:
        central = rows.groupBy("node").agg(F.sum(F.col("n") * F.col("weight")).alias("rank"))
        ranked = rows.join(central, "node")
    outside = F.col("major").isNull() | (F.col("label") != F.col("major"))
    star = F.struct("rank", (-F.col("node")).alias("least"), "label")
    stars = ranked.groupBy("bucket").agg(F.max(F.when(outside, star)).alias("outer"),
                                         F.max(F.when(~outside, star)).alias("inner"))
    pairs = (rows.where(outside).select("bucket", F.col("node").alias("a"), "label").join(stars, "bucket")
             .select("a", "label", F.explode(F.array("outer", "inner")).alias("star"))
             .where("star IS NOT NULL AND star.label <> label")
             .select("a", (-F.col("star.least")).alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merge(labels: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """(node, label) after links (a, b): the labels of linked nodes become one."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if labels is None:
        known = ends.withColumn("label", F.col("node"))
    else:
        known = labels.join(ends, "node", "full").select("node", F.coalesce("label", "node").alias("label"))
    known = materialise(known, f"{name}-known")

    def label_of(end):
        return known.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))

    edges = materialise(links.join(label_of("a"), "a").join(label_of("b"), "b").where("la <> lb")
                        .select(F.least("la", "lb").alias("left"), F.greatest("la", "lb").alias("right"))
                        .distinct(), f"{name}-edges")
    over = edges.select(F.explode(F.array("left", "right")).alias("id")).distinct()
    roots = connected_components(over, edges).select(F.col("id").alias("label"), "root")
    return materialise(known.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")),
                       f"{name}-labels")


def few_pairs(rows: DataFrame, per_row: int = PAIRS_PER_ROW) -> bool:
    """Whether pairing the rows of ``open_buckets`` completely takes at most ``per_row`` pairs for each of them."""
    left = rows.agg(F.sum(F.when(F.col("label") != F.col("major"), F.col("n"))).alias("pairs"),
                    F.count(F.lit(1)).alias("rows")).first()
    return (left["pairs"] or 0) <= per_row * left["rows"]


def settle(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame],
           across: Callable[[DataFrame], DataFrame], name: str, rounds: int = ROUNDS) -> DataFrame | None:
    """(node, label) of linked nodes, null when nothing is linked.

    ``verify`` gives the linked ones of pairs (a, b); ``across`` gives links
    (a, b) between labels of the rows (bucket, node, label, major) that the
    star rounds leave. A round that finds few pairs left is left out, and all
    later ones with it.
    """
    labels = None
    for turn in range(rounds):
        rows = materialise(open_buckets(buckets, labels, turn), f"{name}-open")
        if rows.isEmpty():
            return labels
        if turn and few_pairs(rows):
            break
        links = materialise(verify(star_pairs(rows, turn)), f"{name}-stars")
        if not links.isEmpty():
            labels = merge(labels, links, name)
        elif labels is None:
            labels = rows.sparkSession.createDataFrame([], "node long, label long")
    else:
        rows = materialise(open_buckets(buckets, labels, rounds), f"{name}-open")
    links = materialise(across(rows.select("bucket", "node", "label", "major")), f"{name}-across")
    return labels if links.isEmpty() else merge(labels, links, name)


def deal(rows: DataFrame, payload: DataFrame, size: str, block_rows: int = BLOCK_ROWS,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows in the order of (bucket, block, copy): the nodes of a block, then the copies to compare with them.

    ``payload`` has one row per node; its column ``size`` is a number of bytes.
    """
    weighed = rows.join(payload.select("node", F.col(size).alias("node_bytes")), "node")
    sizes = weighed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("node_bytes").alias("bytes")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(block_rows)), F.ceil(F.col("bytes") / F.lit(block_bytes))).cast("int")
    dealt = rows.join(sizes, "bucket").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    homes = dealt.select("bucket", own.alias("block"), F.lit(0).alias("copy"), "node", "label", "major")
    copies = dealt.where("label <> major").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("copy"),
        "node", "label", "major")
    return (homes.unionByName(copies).join(payload, "node")
            .select("bucket", "block", "copy", "node", "label", "major",
                    *[name for name in payload.columns if name != "node"])
            .repartition("bucket", "block").sortWithinPartitions("bucket", "block", "copy", "node"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """(block, copies): every slice of copies with the whole block it has to be compared with."""
    held: list[pa.RecordBatch] = []
    table, current = None, None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if a == b:
                continue
            bucket, block, copy = keys[:, a].tolist()
            if (bucket, block) != current:
                current, held, table = (bucket, block), [], None
            if not copy:
                held.append(batch.slice(a, b - a))
            elif held:
                table = pa.Table.from_batches(held) if table is None else table
                yield table, batch.slice(a, b - a)


def partners(block: pa.Table, copies: pa.RecordBatch, row: int, labels: np.ndarray, nodes: np.ndarray,
             majors: np.ndarray) -> np.ndarray:
    """Positions in the block that row ``row`` of the copies has to be compared with.

    Of other labels; a pair of two copied nodes is compared where the greater one is at home.
    """
    own, label = copies.column(3)[row].as_py(), copies.column(4)[row].as_py()
    return np.flatnonzero((labels != label) & ((labels == majors) | (nodes > own)))


def named_components(sizes: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes by label, rows that share a doc_id joined, least doc_id as name."""
    if labels is not None:
        classes = classes.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node"))
    rows = materialise(sizes.join(classes.select("set_hi", "set_lo", "node"), ["set_hi", "set_lo"], "left")
                       .select("doc_id", "n_shingles", "node"), "settled-rows")
    split = (rows.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("doc_id", "first"))
    links = materialise(rows.join(split, "doc_id").where("node <> first")
                        .select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "settled-same-id")
    if not links.isEmpty():
        joined = merge(None, links, "settled")
        rows = (rows.join(joined, "node", "left")
                .select("doc_id", "n_shingles", F.coalesce("label", "node").alias("node")))
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("component"))
    return (rows.join(least, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))
