"""Exact near-duplicate links on word sets.

Two texts are linked when their normalised texts are equal, when the Jaccard
similarity of their word sets is at least 0.85, or when it is at least 0.50
and they share a label.

Equal word sets are collapsed to one node first, so a group of copies, however
large, becomes one node with a member list in table form. A node is compared
through a sketch: words are dealt to a few bits for each word of the set, and a
bit is set where an odd number of them fell. Two sketches differ in at most as
many bits as the sets differ in words, so pairs whose sketches differ in more
than the similarity allows are no links. Rows of one label and of one class of
sizes form a grid of cells of bounded size. A task holds the sketches of one
cell, not the words, compares each two of them, and hands on only pairs that may
still reach the similarity. Those are compared on their whole sets. Nothing is
dropped, so clusters are those of all pairs.

Clusters only need connectivity: a node's candidates are then looked at in
pages, and pairs that earlier pages have connected are left out. Links for
review are asked for with ``complete``: then every link comes out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from askgrid.functions import fixed_values as fixed
from askgrid.functions.unicode import folded_words, nfkc_folded, normalized
from askgrid.operators.bounded import broadcast_if_small, materialise
from askgrid.operators.components import connected_components
from askgrid.operators.skew import attach_by_key

# Candidates of a node in the first page; each later page is that many times longer.
PAGE = 64
PIVOT_ROUNDS = 3

# Rows and bytes of sketches of one block; a cell holds two blocks at most.
BLOCK_ROWS = 50_000
BLOCK_BYTES = 16_000_000

# Bits of a sketch for each word, rounded up to a power of two between the least and the most.
SKETCH_BITS = 4
LEAST_BITS, MOST_BITS = 128, 1 << 20

# Bits that a cell compares at first at most, and bits set or compared at once.
FIRST_BITS = 4096
BITS_AT_ONCE = 1 << 22

# Partitions of cells for each core: cells differ in work more than in bytes.
CELL_PARTITIONS = 8

# Pairs of rows that a cell compares at once.
CELL_COUNTERS = 1 << 20

# Bytes of words of the candidates around one node that stay together, and bytes of words and pairs compared in one task.
FAMILY_BYTES = 1_500_000
BUCKET_BYTES, BUCKET_PAIRS = 8_000_000, 500_000


def prepared_texts(documents: DataFrame) -> DataFrame:
    """(id, label, text_hash, set_hash, words) of (id, label, text).

    ``words`` are the distinct words in order, parted by blanks: as text they
    compress better than as hashes.
    """
    return (documents.select("id", "label", normalized(F.col("text")).alias("normal"),
                             _joined_words(F.col("text")).alias("words"))
            .where("normal <> ''")
            .select("id", "label", F.sha2("normal", 256).alias("text_hash"),
                    F.sha2("words", 256).alias("set_hash"), "words"))


def word_sets(documents: DataFrame) -> DataFrame:
    """(id, label, set_hash, words) of the same rows as ``prepared_texts``, without normalised texts."""
    written = nfkc_folded(F.coalesce("text", F.lit(""))).rlike(r"(?U)\S")
    return (documents.where(written).select("id", "label", _joined_words(F.col("text")).alias("words"))
            .select("id", "label", F.sha2("words", 256).alias("set_hash"), "words"))


def _joined_words(text: Column) -> Column:
    return F.array_join(F.sort_array(folded_words(text)), " ")


def exact_groups(prepared: DataFrame) -> DataFrame:
    """(id, representative, copies): each text with the least id that has the same text."""
    groups = prepared.groupBy("text_hash").agg(
        F.min("id").alias("representative"), F.count(F.lit(1)).alias("copies"))
    return attach_by_key(prepared.select("id", "text_hash"), groups, ["text_hash"],
                         "copies").select("id", "representative", "copies")


def nodes_and_members(prepared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, set_hash, size, sketch, words), members (id, node) and labels (node, label)."""
    listed = F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))
    hashed = prepared.withColumn("hashes", F.transform(listed, lambda word: F.xxhash64(word)))
    nodes = (hashed.withColumn("sketch", _sketch("hashes")).groupBy("set_hash")
             .agg(F.min("id").alias("node"), F.first(F.size("hashes")).alias("size"),
                  F.first("sketch").alias("sketch"), F.first("words").alias("words")))
    groups = prepared.groupBy("set_hash").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    members = attach_by_key(prepared.select("id", "label", "set_hash"), groups, ["set_hash"], "n")
    return nodes, members.select("id", "node"), members.select("node", "label").distinct()


def _bits(sizes: np.ndarray) -> np.ndarray:
    wanted = np.maximum(sizes * SKETCH_BITS, LEAST_BITS)
    return np.minimum(1 << np.ceil(np.log2(wanted)).astype(np.int64), MOST_BITS)


@F.arrow_udf(BinaryType())
def _sketch(hashes: pa.Array) -> pa.Array:
    """Bits where an odd number of a set's words fell."""
    sizes = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words, starts, bits = hashes.flatten().to_numpy(), np.cumsum(sizes) - sizes, _bits(sizes)
    found = [b""] * len(sizes)
    for width in np.unique(bits):
        rows = np.flatnonzero(bits == width)
        step = max(1, BITS_AT_ONCE // int(width))
        for part in (rows[at:at + step] for at in range(0, len(rows), step)):
            row = np.repeat(np.arange(len(part)), sizes[part])
            word = words[np.repeat(starts[part] - (np.cumsum(sizes[part]) - sizes[part]), sizes[part]) + np.arange(len(row))]
            odd = np.bincount(row * width + (word & (width - 1)), minlength=len(part) * int(width)) & 1
            packed = np.packbits(odd.astype(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            for place, sketch in zip(part, packed):
                found[place] = sketch.tobytes()
    return pa.array(found, pa.binary())


@F.arrow_udf(BinaryType())
def _quartered(sketches: pa.Array) -> pa.Array:
    """Sketches of a quarter of the bits."""
    found = []
    for sketch in sketches:
        words = np.frombuffer(sketch.as_buffer(), dtype=np.uint64)
        found.append(_folded(words[None, :], max(1, len(words) // 4)).tobytes())
    return pa.array(found, pa.binary())


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches of the same sets in ``width`` times 64 bits: one half of the bits is added to the other."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Attach the exact Jaccard similarity to (left, right, labelled) pairs.

    A set is sent to each task once, not with each pair: nodes go with the least node
    that is a candidate of theirs, and many of them are cut into parts.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("left").alias("node"), F.col("right").alias("other")),
                                          F.struct(F.col("right").alias("node"), F.col("left").alias("other")))).alias("end"))
    anchors = ends.groupBy("end.node").agg(F.min("end.other").alias("other")).select(
        "node", F.least("node", "other").alias("anchor"))
    weighed = anchors.join(sets.groupBy("node").agg(F.sum("bytes").alias("bytes")), "node")
    parts = weighed.groupBy("anchor").agg(F.ceil(F.sum("bytes") / FAMILY_BYTES).alias("parts"))
    placed = materialise(weighed.join(parts, "anchor").select(
        "node", F.xxhash64("anchor", F.pmod(F.xxhash64("node"), "parts")).alias("place")), "placed")
    held, many = sets.agg(F.sum("bytes")).first()[0] or 0, pairs.count()
    buckets = max(1, math.ceil(2 * held / BUCKET_BYTES), math.ceil(many / BUCKET_PAIRS))
    dealt = materialise(
        pairs.join(placed.select(F.col("node").alias("left"), F.col("place").alias("at")), "left")
        .join(placed.select(F.col("node").alias("right"), F.col("place").alias("to")), "right")
        .select("left", "right", "labelled", F.pmod(F.xxhash64("at", "to"), F.lit(buckets)).cast("int").alias("bucket")), "dealt")
    needed = (dealt.select(F.col("bucket").alias("to"), F.explode(F.array("left", "right")).alias("node")).distinct()
              .join(sets.select("node", "words"), "node"))
    return dealt.groupBy("bucket").cogroup(needed.groupBy("to")).applyInArrow(
        _jaccards, "left bigint, right bigint, labelled boolean, jaccard double")


def _jaccards(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Pairs with the similarity of their sets; a node that stands for several sets is compared in each."""
    sets = sets.sort_by("node")
    node = sets.column("node").to_numpy()
    lists = pc.split_pattern(sets.column("words").combine_chunks(), " ")
    starts, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
    sizes, vocabulary, words = np.diff(starts), len(words.dictionary), words.indices.to_numpy()
    left, right = pairs.column("left").to_numpy(), pairs.column("right").to_numpy()
    lefts, rights = (np.searchsorted(node, end, side="right") - np.searchsorted(node, end) for end in (left, right))
    pair = np.repeat(np.arange(len(left)), lefts * rights)
    turn = np.arange(len(pair)) - np.repeat(np.cumsum(lefts * rights) - lefts * rights, lefts * rights)
    i = np.searchsorted(node, left)[pair] + turn // rights[pair]
    j = np.searchsorted(node, right)[pair] + turn % rights[pair]
    order = np.argsort(i, kind="stable")
    pair, i, j = pair[order], i[order], j[order]
    shared, marked = np.zeros(len(pair), dtype=np.int64), np.zeros(vocabulary, dtype=bool)
    edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for start, end in zip(edges[:-1], edges[1:]):
        own, met = words[starts[i[start]]:starts[i[start] + 1]], j[start:end]
        marked[own] = True
        begins = np.cumsum(sizes[met]) - sizes[met]
        at = np.repeat(starts[met] - begins, sizes[met]) + np.arange(sizes[met].sum())
        shared[start:end] = np.add.reduceat(marked[words[at]], begins, dtype=np.int64)
        marked[own] = False
    return pa.table({"left": left[pair], "right": right[pair],
                     "labelled": pairs.column("labelled").take(pa.array(pair)),
                     "jaccard": shared / (sizes[i] + sizes[j] - shared)})


def _sets(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, words, bytes) of the ends of pairs, once for each node and set."""
    ends = pairs.select(F.explode(F.array("left", "right")).alias("node")).distinct()
    named = materialise(nodes.select("node", "set_hash").join(ends, "node", "left_semi"), "ends")
    return materialise(texts.join(broadcast_if_small(named), ["node", "set_hash"], "left_semi")
                       .dropDuplicates(["node", "set_hash"])
                       .select("node", "words", F.octet_length("words").alias("bytes")), "sets")


def _cells(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Rows (keys, node, size, sketch, root, open) dealt to cells that hold each pair of matching sizes once.

    Sets of a similarity are in the same class of sizes or in neighbouring ones:
    a row is at home in its class and a guest in the next.
    """
    steps = F.log(F.col("size")) / F.lit(1.001 * math.log(1.0 / threshold))
    classed = (rows.withColumn("own", F.floor(steps).cast("int"))
               .withColumn("class", F.explode(F.array(F.col("own"), F.col("own") + 1)))
               .withColumn("guest", F.col("class") > F.col("own")).drop("own"))
    keys = [*keys, "class"]
    held = classed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("open") & ~F.col("guest")).alias("left_over"), F.sum(F.octet_length("sketch")).alias("held")) \
        .where("n > 1 AND left_over")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("held") / BLOCK_BYTES)).cast("int")
    sizes = materialise(held.select(*keys, blocks.alias("blocks")), "cells")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (classed.join(broadcast_if_small(sizes), keys)
            .withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(*keys, F.least("block", "other").alias("row"), F.greatest("block", "other").alias("column"),
                    "block", "guest", "node", "size", "sketch", "root", "open"))


def _first_width(size: int, threshold: float, width: int) -> int:
    """In how many times 64 bits sets of a size are compared first: as few as tell most unrelated sets apart."""
    least = 1
    while least < min(width, FIRST_BITS // 64):
        bits, apart = 64 * least, 1.7 * size
        if bits / 2 * (1 - math.exp(-2 * apart / bits)) - 2 * math.sqrt(bits) > 2 * size * (1 - threshold) / (1 + threshold):
            break
        least *= 2
    return least


def _as_numbers(sketches: np.ndarray, sizes: np.ndarray, slack: float, left: bool) -> np.ndarray:
    """Bits as numbers with two columns more: products of rows are positive where so many bits may differ."""
    bits = np.unpackbits(sketches.view(np.uint8), axis=1)
    ends = (bits.sum(axis=1, dtype=np.int64) - slack * sizes) / 2
    ends = np.stack([np.ones(len(ends)), -ends] if left else [-ends, np.ones(len(ends))], axis=1)
    return np.concatenate([bits, ends], axis=1, dtype=np.float32)


def _near(left: tuple, right: tuple, threshold: float, places: np.ndarray | None):
    """(left, right) places of rows that may reach the threshold, for a tile of left rows at a time and in order.

    A side is (sizes, sketches) in the order of sizes. ``places`` are those of the left rows
    among the right ones where both sides are one: then only later rows are looked at.
    """
    (sizes, sketches), (others, held) = left, right
    width = min(sketches.shape[1], held.shape[1])
    sketches, held = _folded(sketches, width), _folded(held, width)
    slack = (1 - threshold) / (1 + threshold)
    first = _first_width(int(max(sizes[-1], others[-1])), threshold, width)
    short, tile = _folded(held, first), max(1, math.isqrt(CELL_COUNTERS))
    step = max(1, BITS_AT_ONCE // (64 * width))
    for start in range(0, len(sizes), tile):
        end = min(start + tile, len(sizes))
        low = int(np.searchsorted(others, sizes[start] * threshold - 1e-6))
        high = int(np.searchsorted(others, sizes[end - 1] / threshold + 1e-6, side="right"))
        if places is not None:
            low = max(low, int(places[start]) + 1)
        rows = _as_numbers(_folded(sketches[start:end], first), sizes[start:end], slack, True)
        found = [np.zeros((2, 0), dtype=np.int64)]
        for at in range(low, high, tile):
            to = min(at + tile, high)
            near = rows @ _as_numbers(short[at:to], others[at:to], slack, False).T > -0.5
            i, j = np.divmod(np.flatnonzero(near), to - at)
            i, j = i + start, j + at
            if places is not None:
                later = j > places[i]
                i, j = i[later], j[later]
            for part in range(0, len(i), step):
                p, q = i[part:part + step], j[part:part + step]
                apart = np.bitwise_count(sketches[p] ^ held[q]).sum(axis=1, dtype=np.int64)
                both, most = sizes[p] + others[q], np.maximum(sizes[p], others[q])
                fit = (apart <= slack * both + 1e-3) & (both - most >= most * threshold - 1e-6)
                found.append(np.stack([p[fit], q[fit]]))
        i, j = np.concatenate(found, axis=1)
        order = np.argsort(i, kind="stable")
        yield i[order], j[order]


def _by_width(sketches: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and sketches, apart for each length of sketches."""
    lengths = pc.binary_length(sketches).to_numpy()
    groups = []
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        data = b"".join(sketches.take(pa.array(rows)).to_pylist())
        groups.append((rows, np.frombuffer(data, dtype=np.uint64).reshape(len(rows), -1)))
    return groups


def _candidates_in_cell(table: pa.Table, threshold: float, skipped: int, limit: int | None):
    """(left, right) row numbers that may reach the threshold, one page of each left row, and left rows with further ones.

    Rows are in the order of sizes. Guests are never on the left: they meet each other in their
    own class. Of two blocks only pairs across are looked at, and only open rows are on the left.
    """
    sizes, block, guest, root, opened = (
        table.column(name).to_numpy() for name in ("size", "block", "guest", "root", "open"))
    sizes, home, opened = sizes.astype(np.int64), ~guest.astype(bool), opened.astype(bool)
    one, two = block == block.min(), block == block.max()
    across = block.min() != block.max()
    sides = [(one & home, two & home), (one & home, two & ~home), *([(two & home, one & ~home)] if across else [])]
    groups = _by_width(table.column("sketch"))
    for number, (lefts, rights) in enumerate(sides):
        same = number == 0 and not across
        for turn, (left, left_sketches) in enumerate(groups):
            chosen = (lefts & opened)[left]
            places = np.flatnonzero(opened[left[lefts[left]]])
            left, left_sketches = left[chosen], left_sketches[chosen]
            for right, right_sketches in groups[turn if same else 0:]:
                itself = same and right_sketches is groups[turn][1]
                met = rights[right]
                right, right_sketches = right[met], right_sketches[met]
                if not len(left) or not len(right):
                    continue
                for i, j in _near((sizes[left], left_sketches), (sizes[right], right_sketches), threshold,
                                  places if itself else None):
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = left[i], right[j]
                    far = root[i] != root[j]
                    page = far & (rank >= skipped) & (limit is None or rank < skipped + limit)
                    more = i[far & (rank >= skipped + limit)] if limit is not None else i[:0]
                    yield i[page], j[page], np.unique(more)


def _candidates(rows: DataFrame, keys: list[str], threshold: float, skipped: int = 0,
                limit: int | None = None) -> DataFrame:
    """(left, right) pairs that may reach the threshold; ``right`` is null where a node has further pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by([("size", "ascending"), ("node", "ascending")])
        node = table.column("node").to_numpy()
        for left, right, more in _candidates_in_cell(table, threshold, skipped, limit):
            left, right, more = node[left], node[right], node[more]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.minimum(left, right), more])),
                 pa.concat_arrays([pa.array(np.maximum(left, right)), pa.nulls(len(more), pa.int64())])],
                names=["left", "right"])

    keys, spark = [*keys, "class", "row", "column"], rows.sparkSession
    dealt = _cells(rows, keys[:-3], threshold).repartition(
        CELL_PARTITIONS * spark.sparkContext.defaultParallelism, *keys)
    return dealt.groupBy(*keys).applyInArrow(run, "left bigint, right bigint")


def _measured(rows: list[tuple[DataFrame, list[str], float]], nodes: DataFrame, texts: DataFrame, skipped: int = 0,
              limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(left, right, jaccard, reasons) of the links in a page of candidates, and the nodes that have further ones, if any.

    Each of ``rows`` is (rows, keys, threshold): pairs found under a label as key have it in common.
    """
    found = None
    for frame, keys, threshold in rows:
        part = _candidates(frame, keys, threshold, skipped, limit).withColumn("labelled", F.lit(bool(keys)))
        found = part if found is None else found.unionByName(part)
    found = materialise(found.groupBy("left", "right").agg(F.max("labelled").alias("labelled")), "candidates")
    pairs = found.where("right IS NOT NULL")
    measured = materialise(_with_reasons(_similarity(pairs, _sets(pairs, nodes, texts))), "measured")
    more = found.where("right IS NULL").select(F.col("left").alias("node")).distinct()
    return measured, None if limit is None or more.isEmpty() else more


def _with_reasons(measured: DataFrame) -> DataFrame:
    """(left, right, jaccard, reasons) of measured pairs that are links."""
    high = F.col("jaccard") >= fixed.NEAR_DUPLICATE_JACCARD - 1e-12
    labelled = F.col("labelled") & (F.col("jaccard") >= fixed.SAME_LABEL_JACCARD - 1e-12)
    reasons = F.array_join(F.filter(F.array(F.when(high, "jaccard"), F.when(labelled, "same_label")),
                                    lambda reason: reason.isNotNull()), ",")
    return measured.where(high | labelled).select("left", "right", "jaccard", reasons.alias("reasons"))


def node_links(nodes: DataFrame, labels: DataFrame, large: int = PAGE,
               complete: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """(left, right, jaccard, reasons) between nodes: all links, or enough to connect every cluster.

    Where not all links are asked for, a reason may be missing. ``large`` is the number of candidates of a node in the first page; after
    ``PIVOT_ROUNDS`` pages the rest is one page. ``texts`` is a table with the
    words of all rows (id, set_hash, words); else they are taken from the nodes.
    """
    high, low = fixed.NEAR_DUPLICATE_JACCARD, fixed.SAME_LABEL_JACCARD
    texts = nodes.select("node", "set_hash", "words") if texts is None else texts.select(
        F.col("id").alias("node"), "set_hash", "words")
    nodes = materialise(nodes.where("node IS NOT NULL AND size > 0").select("node", "set_hash", "size", "sketch"), "nodes")
    labels = materialise(labels, "labels")
    labelled = nodes.join(labels.where("label IS NOT NULL"), "node")

    def rows(known=None):
        parts = [(nodes.withColumn("sketch", _quartered("sketch")), [], high), (labelled, ["label"], low)]
        if known is None:
            return [(frame.withColumn("root", F.col("node")).withColumn("open", F.lit(True)), keys, t)
                    for frame, keys, t in parts]
        return [(frame.join(known, "node"), keys, t) for frame, keys, t in parts]

    if complete:
        return _measured(rows(), nodes, texts)[0]
    links, known, skipped, limit = None, None, 0, large
    for turn in range(PIVOT_ROUNDS + 1):
        found, more = _measured(rows(known), nodes, texts, skipped, limit if turn < PIVOT_ROUNDS else None)
        links = materialise(found if links is None else links.unionByName(found).distinct(), "node-links")
        if more is None:
            break
        roots = connected_components(nodes.select(F.col("node").alias("id")), links)
        known = materialise(roots.select(F.col("id").alias("node"), "root").distinct()
                            .join(more.withColumn("further", F.lit(True)), "node", "left")
                            .select("node", "root", F.coalesce("further", F.lit(False)).alias("open")), "roots")
        skipped, limit = skipped + limit, limit * large
    return links
