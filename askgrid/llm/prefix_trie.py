"""Trie of conversation prefixes with totals of every subtree.

A node is a distinct sequence of the first ``depth`` turns of some conversation;
its members are the conversations that start with it, and it is named by its
smallest member and its depth. Nodes come out of one grouping of running
128-bit hashes of the turns, so texts are not shuffled to build the trie.

Subtree totals come from a centroid decomposition of the forest of parent edges:

1. Every component of not yet handled nodes has a top. Its weight is the number
   of turns of conversations in it. A node's weight below it inside its
   component is known from the start, as the number of turns of its members
   from there on, and stays known (step 4).
2. The centroid is the deepest node with half of its component's weight or more
   below it. Below it and above it no more than half of the weight is left.
3. The values of the component at and below the centroid are added up and
   written as one increment for every node on the path from the centroid to the
   top. That path is read from the rows of the centroid's smallest member, so
   no chain of parents is followed step by step.
4. The centroid is done; each of its children tops a new component; the weight
   that hung below it is taken from the nodes above it.

Two nodes of one branch are parted by exactly one centroid, so the sum of a
node's increments is its total. The levels are at most the logarithm of the
number of turns, for a single chain as well as for a star. Components of at
most ``small`` nodes are finished together, by the same steps, inside tasks.

Null conversation ids are left out; null roles and texts are empty; turns of one
conversation are ordered by turn (null first), role and text; repeated rows are
turns of their own. An empty table has no nodes. The rows of one conversation are
numbered by a window of Spark that spills; nothing else meets by conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.common import materialise
from askgrid.operators.bounded import MAX_BROADCAST_ROWS, fits, small_side

SMALL = 4096
ID_RANGE = 4096
LONGEST_PREFIX = 8


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its five."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(LONGEST_PREFIX + 1)).cast("int")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, h1, h2, bytes): the turns in order, from 1, with two hashes and the size of the text."""
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"),
        role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("at"),
                       F.xxhash64("role", "text").alias("h1"),
                       F.xxhash64(F.lit("second"), "text", "role").alias("h2"),
                       F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, bytes, length): turns of every rebuilt conversation.

    A conversation of five is given the first turns of the first of them, then
    its own after as many. Depth 0, without a turn, stands for the start.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("own"))
    shared = shared_turns(F.col("conv_id"))
    plan = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), shared.alias("h"), "own")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("offered"))
    plan = (plan.join(bases, "base", "left")
            .withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0))))
            .withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    plan = materialise(plan.select("conv_id", "base", "h", "taken", "length"), "trie-plan")
    first = (plan.join(turns.where(F.col("at") <= LONGEST_PREFIX).withColumnRenamed("conv_id", "base"), "base")
             .where("at <= h").select("conv_id", F.col("at").alias("depth"), "h1", "h2", "bytes", "length"))
    rest = (plan.join(turns, "conv_id").where("at > h")
            .select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("depth"), "h1", "h2", "bytes", "length"))
    start = plan.select("conv_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("h1"),
                        F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("bytes"), "length")
    return start.unionByName(first).unionByName(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, length, p1, p2): a row per conversation and depth with its prefix's hash."""
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "depth", "bytes", "length",
                       F.bit_xor(F.xxhash64("h1", "depth")).over(so_far).alias("p1"),
                       F.bit_xor(F.xxhash64("depth", "h2")).over(so_far).alias("p2"))


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths).

    nodes: (conv_id, depth, parent_conv_id, n_convs, bytes, below), ``below``
    being the turns of the members from this one on. paths: (conv_id, depth,
    owner, length), the node of every conversation at every depth.
    """
    rows = materialise(prefixes(rebuilt(materialise(turns_of(conversations), "trie-turns"))), "trie-prefixes")
    found = materialise(
        rows.groupBy("depth", "p1", "p2").agg(
            F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
            F.sum(F.col("length") - F.col("depth") + 1).cast("long").alias("below")), "trie-groups")
    paths = materialise(rows.select("conv_id", "depth", "p1", "p2", "length")
                        .join(found.select("depth", "p1", "p2", "owner"), ["depth", "p1", "p2"])
                        .select("conv_id", "depth", "owner", "length"), "trie-paths")
    parents = paths.select(F.col("conv_id").alias("owner"), (F.col("depth") + 1).alias("depth"),
                           F.col("owner").alias("parent_conv_id"))
    nodes = (found.join(parents, ["owner", "depth"], "left")
             .select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "bytes", "below"))
    return materialise(nodes, "trie-nodes"), paths


def _levels(state: DataFrame, large: DataFrame, paths: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """One level of the decomposition of the large components: (increments, nodes of the new components)."""
    component = ["top_conv", "top_depth"]
    centroids = materialise(
        state.join(small_side(large, few), component).where(F.col("below") * 2 >= F.col("weight")).groupBy(*component)
        .agg(F.max(F.struct("depth", "conv_id", "below")).alias("best"))
        .select(*component, F.col("best.depth").alias("z_depth"), F.col("best.conv_id").alias("z_conv"),
                F.col("best.below").alias("z_below")), "trie-centroids")
    here = state.join(small_side(centroids, few), component)
    # The ancestors of a node at the centroid's depth and one deeper, from the rows of its smallest member.
    wanted = here.withColumn("at", F.explode(F.array("z_depth", F.col("z_depth") + 1)))
    seen = paths.select("conv_id", F.col("depth").alias("at"), "owner")
    looked = (wanted.where("at <= depth").join(seen, ["conv_id", "at"])
              .groupBy("conv_id", "depth").agg(F.min_by("owner", "at").alias("above"),
                                               F.max_by("owner", "at").alias("child"), F.max("at").alias("reach")))
    placed = materialise(
        here.join(looked, ["conv_id", "depth"], "left")
        .withColumn("inside", F.coalesce((F.col("depth") >= F.col("z_depth")) & (F.col("above") == F.col("z_conv")),
                                         F.lit(False))), "trie-placed")
    sums = (placed.where("inside").groupBy(*component)
            .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    path = (centroids.join(sums, component)
            .withColumn("depth", F.explode(F.sequence("top_depth", "z_depth")))
            .join(paths.select(F.col("conv_id").alias("z_conv"), "depth", F.col("owner").alias("conv_id")),
                  ["z_conv", "depth"]))
    increments = materialise(path.select(
        "conv_id", "depth", "leaves", "saved",
        F.when(F.col("depth") < F.col("z_depth"), F.col("z_below")).otherwise(F.lit(0)).alias("gone")),
        "trie-increments")
    after = placed.join(increments.select("conv_id", "depth", "gone"), ["conv_id", "depth"], "left")
    inside = F.col("inside")
    following = (after.where(~(inside & (F.col("depth") == F.col("z_depth"))))
                 .select("conv_id", "depth", "parent_conv_id", "leaves", "saved",
                         (F.col("below") - F.when(inside, F.lit(0)).otherwise(F.coalesce("gone", F.lit(0)))).alias("below"),
                         F.when(inside, F.col("child")).otherwise(F.col("top_conv")).alias("top_conv"),
                         F.when(inside, F.col("z_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth")))
    return increments.select("conv_id", "depth", "leaves", "saved"), materialise(following, "trie-state")


def centroid_totals(keys: list, parents: list, weights: list, values: list) -> list:
    """Sums of values over subtrees of one small component, by centroids.

    ``keys`` are sorted tops first; ``parents`` are positions, -1 for the top;
    ``weights`` are those below each node; ``values`` are tuples.
    """
    below, totals = list(weights), [[0] * len(value) for value in values]
    children: list[list[int]] = [[] for _ in keys]
    for node, parent in enumerate(parents):
        if parent >= 0:
            children[parent].append(node)
    alive, tops = [True] * len(keys), [0] if keys else []
    while tops:
        top = tops.pop()
        centre = top
        while (heavy := next((c for c in children[centre] if alive[c] and 2 * below[c] >= below[top]), None)) is not None:
            centre = heavy
        sums, stack = [0] * len(values[0]), [centre]
        while stack:
            node = stack.pop()
            sums = [a + b for a, b in zip(sums, values[node])]
            stack += [c for c in children[node] if alive[c]]
        node, gone = centre, below[centre]
        while True:
            totals[node] = [a + b for a, b in zip(totals[node], sums)]
            below[node] -= gone if node != centre else 0
            if node == top:
                break
            node = parents[node]
        alive[centre] = False
        tops += [c for c in children[centre] if alive[c]] + ([top] if centre != top else [])
    return totals


def _finish(state: DataFrame) -> DataFrame:
    """Increments of whole small components; a task handles one component after the other."""
    fields = ["top_conv", "top_depth", "depth", "conv_id", "parent_conv_id", "below", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solved():
            place = {(row[3], row[2]): at for at, row in enumerate(held)}
            found = centroid_totals(held, [-1 if not at else place[row[4], row[2] - 1] for at, row in enumerate(held)],
                                    [row[5] for row in held], [row[6:] for row in held])
            return [(row[3], row[2], *total) for row, total in zip(held, found)]

        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    out += solved()
                    held = []
                held.append(row)
            yield _increments(out)
        yield _increments(solved() if held else [])

    return (state.select(*fields).repartition("top_conv", "top_depth")
            .sortWithinPartitions("top_conv", "top_depth", "depth", "conv_id")
            .mapInArrow(run, "conv_id long, depth int, leaves long, saved long"))


def _increments(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["conv_id", "depth", "leaves", "saved"])


def subtree_totals(state: DataFrame, paths: DataFrame, small: int = SMALL) -> DataFrame:
    """(conv_id, depth, leaves, saved) summed over every node's subtree.

    ``state`` has the nodes with their parent, their own values, what is below
    them and the top of their component.
    """
    component, parts = ["top_conv", "top_depth"], []
    while True:
        large = materialise(state.groupBy(*component).agg(
            F.count(F.lit(1)).alias("size"), F.max("below").alias("weight")).where(F.col("size") > small), "trie-large")
        few = fits(large, MAX_BROADCAST_ROWS)
        parts.append(_finish(state.join(small_side(large.select(*component), few), component, "left_anti")))
        if large.isEmpty():
            break
        increments, state = _levels(state, large.select(*component, "weight"), paths, few)
        parts.append(increments)
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def end_hashes(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes where conversations end.

    Ids are joined by ranges first; a task then feeds the ranges of one node, in
    order, to its digest, so it never holds the ids of a node.
    """
    ends = paths.where("depth = length").select(F.col("owner").alias("node"), "depth", "conv_id")
    parts = (ends.groupBy("node", "depth", F.floor(F.col("conv_id") / ID_RANGE).alias("part"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")),
                                           lambda c: c.cast("string")), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        current, digest = None, None
        for batch in batches:
            out = []
            for node, depth, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if (node, depth) != current:
                    if current:
                        out.append((*current, digest.hexdigest()))
                    current, digest = (node, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _ends(out)
        yield _ends([(*current, digest.hexdigest())] if current else [])

    return (parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "part")
            .select("node", "depth", "ids").mapInArrow(run, "conv_id long, depth int, ends_sha256 string"))


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string()))],
        names=["conv_id", "depth", "ends_sha256"])


def prefix_nodes(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per trie node: its smallest member, depth, parent, members, children and subtree totals."""
    nodes, paths = trie(conversations)
    children = nodes.where("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    known = materialise(
        nodes.join(children, ["conv_id", "depth"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie-known")
    root = known.where("depth = 0").agg(F.min("conv_id")).first()[0]
    state = known.select("conv_id", "depth", "parent_conv_id", "leaves", "saved", "below",
                         F.lit(root).cast("long").alias("top_conv"), F.lit(0).alias("top_depth"))
    totals = subtree_totals(state, paths, small)
    empty = F.sha2(F.lit(""), 256)
    return (known.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")
            .join(totals, ["conv_id", "depth"])
            .join(end_hashes(paths), ["conv_id", "depth"], "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                    F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", empty).alias("ends_sha256")))
