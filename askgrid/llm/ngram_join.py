"""Jaccard self-join of documents on their word n-grams by vertical partitioning.

A document is the set of its distinct ``width``-word runs, as 64-bit hashes; two
documents are linked when 100 * |intersection| >= percent * |union|.

1. Equal sets (by a 128-bit hash) collapse to one class before anything else.
2. A first cut of the gram space into fragments counts, per class, the grams
   that some other class has too. A task sends each distinct gram of a batch of
   documents once, 32 bits of it to the fragment named by the others, and gets
   back how many are shared. A partner at the threshold shares at least
   ceil(percent * n / 100) of a set of n, so classes with fewer are done. Equal
   bits of different grams can only keep a class that has no partner.
3. What is left gets the global order of grams: by the bit length of their exact
   number of sets, then by hash, so rare ones are first. Quantiles cut the order
   into ``fragments`` ranges, and every set into one segment per range.
4. A linked pair has a common gram within the first |shared| - needed + 1 of
   both sets: each such prefix gram is a bucket.
5. Pairs are verified by fragments: overlaps of the segments are counted
   fragment by fragment, as separate rows, and summed per pair. Large buckets
   are settled by star rounds and bounded blocks (``settle``); blocks count the
   same fragments one after the other and leave off pairs that cannot reach the
   needed overlap any more.

The prefixes, the fragments and the settling give exactly the components of all
pairs; no group is paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm import settle
from askgrid.llm.common import materialise
from askgrid.llm.minhash import shingle_hashes
from askgrid.operators.bounded import broadcast_if_small

WIDTH, PERCENT = 3, 90
FRAGMENTS = 8
BATCH_GRAMS = 1_000_000
FRAGMENT_GRAMS = 2_000_000
MAX_BROADCAST_IDS = 500_000


def _sets(batches: Iterator[pa.RecordBatch], width: int, rows: int = 512) -> Iterator[list]:
    """Lists of (doc_id, high, low, hashes) of the documents of a slice; without words the hashes are null."""
    import xxhash
    for batch in (whole.slice(k, rows) for whole in batches for k in range(0, whole.num_rows, rows)):
        out = []
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            found = shingle_hashes(raw or b"", width)
            high, low = (np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist()
                         if len(found) else (None, None))
            out.append((doc_id, high, low, found))
        yield out


def _batch(columns, kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def set_sizes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo), a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sets(batches, width):
            columns = [[r[0] for r in rows], [len(r[3]) for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
            yield _batch(columns, [pa.int64()] * 4, ["doc_id", "n_shingles", "set_hi", "set_lo"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long"))


def _shares(wanted: list, fragments: int) -> Iterator[tuple]:
    """Rows (fragment, payload parts) of one batch of sets: first its own counts, then each fragment's grams.

    Grams that several sets of the batch hold are known to be shared: they are
    counted here and sent once.
    """
    sizes = np.array([len(r[3]) for r in wanted])
    flat, owner = np.concatenate([r[3] for r in wanted]), np.repeat(np.arange(len(wanted), dtype=np.uint32), sizes)
    values, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    alone = counts[back] == 1
    yield -1, owner, np.bincount(owner[~alone], minlength=len(wanted)).astype(np.uint32), None
    places = ((values >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    single, single_owner = flat[alone], owner[alone]
    single_place = ((single >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(single_place, kind="stable")
    single, single_owner = single[order].astype(np.uint32), single_owner[order]
    ends = np.searchsorted(single_place[order], np.arange(fragments + 1))
    many, many_place = values[counts > 1].astype(np.uint32), places[counts > 1]
    many_ends = np.searchsorted(many_place, np.arange(fragments + 1))
    for f in range(fragments):
        (a, b), (c, d) = ends[f:f + 2], many_ends[f:f + 2]
        if a < b or c < d:
            yield f, single_owner[a:b], single[a:b], many[c:d]


def shared_counts(docs: DataFrame, total: int, width: int, percent: int, batch_grams: int = BATCH_GRAMS,
                  fragment_grams: int = FRAGMENT_GRAMS) -> DataFrame:
    """(doc_id, set_hi, set_lo, n) of sets of which enough grams occur in another row, too.

    ``total`` is the number of grams of all rows; fragments grow with it.
    """
    fragments = max(1, -(-total // fragment_grams))
    layout = "deal long, fragment int, batch string, owners binary, grams binary, many binary, ids binary, sizes binary"
    names = [part.split()[0] for part in layout.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams, task, number = [], 0, TaskContext.get().partitionId(), 0

        def flushed():
            batch, out = f"{task}-{number}", []
            for fragment, owners, found, many in _shares(held, fragments):
                if fragment < 0:
                    ids = np.array([r[:3] for r in held], np.int64).tobytes()
                    sizes = np.array([len(r[3]) for r in held], np.uint32).tobytes()
                    out.append((-1 - task, -1, batch, b"", found.tobytes(), b"", ids, sizes))
                else:
                    out.append((fragment, fragment, batch, owners.tobytes(), found.tobytes(), many.tobytes(), b"", b""))
            return _batch(zip(*out), kinds, names)

        for rows in _sets(batches, width):
            for row in rows:
                if len(row[3]):
                    held.append(row)
                    grams += len(row[3])
                if grams >= batch_grams:
                    yield flushed()
                    held, grams, number = [], 0, number + 1
        if held:
            yield flushed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def counted():
            every = np.concatenate([np.frombuffer(r["grams"], np.uint32) for r in held]
                                   + [np.repeat(np.frombuffer(r["many"], np.uint32), 2) for r in held])
            every.sort()
            shared = np.unique(every[1:][every[1:] == every[:-1]])
            for row in held:
                grams, owners = np.frombuffer(row["grams"], np.uint32), np.frombuffer(row["owners"], np.uint32)
                at = np.minimum(np.searchsorted(shared, grams), max(len(shared) - 1, 0))
                hit = owners[shared[at] == grams] if len(shared) else owners[:0]
                where, number = np.unique(hit, return_counts=True)
                yield (-1, -1, row["batch"], where.astype(np.uint32).tobytes(), number.astype(np.uint32).tobytes(),
                       b"", b"", b"")

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["fragment"] < 0:
                    out.append(tuple(row.values()))
                    continue
                if held and held[0]["fragment"] != row["fragment"]:
                    out += counted()
                    held = []
                held.append(row)
            yield _batch(zip(*out) if out else [()] * 8, kinds, names)
        if held:
            yield _batch(zip(*counted()), kinds, names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def enough():
            head = next(r for r in held if r["ids"])
            ids = np.frombuffer(head["ids"], np.int64).reshape(-1, 3)
            sizes, shared = np.frombuffer(head["sizes"], np.uint32).astype(np.int64), np.zeros(len(ids), np.int64)
            shared += np.frombuffer(head["grams"], np.uint32)
            for row in held:
                if row is not head:
                    shared[np.frombuffer(row["owners"], np.uint32)] += np.frombuffer(row["grams"], np.uint32)
            keep = 100 * shared >= percent * sizes
            return _batch([*ids[keep].T, sizes[keep]], [pa.int64()] * 4, ["doc_id", "set_hi", "set_lo", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["batch"] != row["batch"]:
                    yield enough()
                    held = []
                held.append(row)
        if held:
            yield enough()

    # Written, so that a task that runs again finds the same batches.
    pieces = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, layout),
                         "join-pieces")
    counted = (pieces.repartition("deal").sortWithinPartitions("deal", "fragment").mapInArrow(count, layout))
    return (counted.repartition("batch").sortWithinPartitions("batch")
            .mapInArrow(add, "doc_id long, set_hi long, set_lo long, n long"))


def gram_lists(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, set_hi, set_lo, grams), for rows with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sets(batches, width):
            rows = [r for r in rows if len(r[3])]
            columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows],
                       [r[3].view(np.int64) for r in rows]]
            yield _batch(columns, (*[pa.int64()] * 3, pa.list_(pa.int64())), ["doc_id", "set_hi", "set_lo", "grams"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, set_hi long, set_lo long, grams array<long>"))


def ordered_sets(lists: DataFrame, percent: int) -> DataFrame:
    """(node, n, keys, prefix): shared grams in the global order, and how many of them are the prefix.

    A key is the bit length of the gram's number of sets above 57 bits of its
    hash. Sets that cannot reach a partner any more are left out.
    """
    rows = lists.select("node", F.explode("grams").alias("gram"))
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    key = F.shiftleft(F.length(F.bin("df")).cast("long"), 57).bitwiseOR(F.shiftrightunsigned("gram", 7))
    sets = (rows.join(counts, "gram").groupBy("node").agg(F.array_sort(F.collect_list(key)).alias("keys"))
            .join(lists.select("node", "n"), "node"))
    needed = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    return (sets.withColumn("prefix", F.size("keys") - needed + 1).where("prefix > 0")
            .select("node", "n", "keys", "prefix"))


def cut_points(sets: DataFrame, fragments: int = FRAGMENTS) -> list[int]:
    """Keys that cut the global order into ranges of about equal weight."""
    shares = [k / fragments for k in range(1, fragments)]
    found = sets.select(F.explode("keys").alias("key")).agg(F.percentile_approx("key", shares, 1000).alias("cuts")).first()
    return sorted(set(found.cuts or []))


def segments(sets: DataFrame, cuts: list[int]) -> DataFrame:
    """(node, fragment, segment) of every set, without empty ones."""
    ends = [0, *cuts, (1 << 63) - 1]

    def part(low: int, high: int):
        return F.filter("keys", lambda key: (key >= low) & (key < high))

    parts = F.array(*map(part, ends, ends[1:]))
    return sets.select("node", F.posexplode(parts).alias("fragment", "segment")).where(F.size("segment") > 0)


def verified(pairs: DataFrame, sets: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity: partial overlaps by fragment, summed per pair."""
    sizes = sets.select("node", "n")
    sized = (pairs.join(sizes.withColumnsRenamed({"node": "a", "n": "na"}), "a")
             .join(sizes.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
             .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    one = pieces.withColumnsRenamed({"node": "a", "segment": "left"})
    two = pieces.withColumnsRenamed({"node": "b", "segment": "right"})
    partial = (sized.join(one, "a").join(two, ["b", "fragment"])
               .select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).cast("long").alias("common")))
    return (partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
            .where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"))


def block_links(rows: DataFrame, sets: DataFrame, cuts: list[int], percent: int,
                block_rows: int = settle.BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between labels of a bucket; one for each node and other label suffices."""
    payload = sets.select("node", "n", "keys", (F.size("keys") * 8).cast("long").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for table, copies in settle.blocks(batches):
            if table is not known:
                known = table
                node, label, major, n = (table.column(k).to_numpy() for k in ("node", "label", "major", "n"))
                lists = table.column("keys").combine_chunks()
                sizes = lists.value_lengths().to_numpy()
                flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
            links = []
            for row, (own, size, keys) in enumerate(zip(*(copies.column(k).to_pylist() for k in ("node", "n", "keys")))):
                others = settle.partners(table, copies, row, label, node, major)
                others = others[np.minimum(n[others], size) * 100 >= np.maximum(n[others], size) * percent]
                if not len(others):
                    continue
                needed = -(-percent * (n + size) // (100 + percent))
                keys, common, rest = np.array(keys, np.int64), np.zeros(len(node), np.int64), sizes.copy()
                ends = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                marks = [0, *np.searchsorted(flat, cuts).tolist(), len(flat)]
                for f in range(len(cuts) + 1):
                    part = flat[marks[f]:marks[f + 1]]
                    mine = keys[ends[f]:ends[f + 1]]
                    low, high = np.searchsorted(part, mine), np.searchsorted(part, mine, side="right")
                    spans = high - low
                    at = np.repeat(low - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
                    common += np.bincount(owner[marks[f] + at], minlength=len(node))
                    rest -= np.bincount(owner[marks[f]:marks[f + 1]], minlength=len(node))
                    left = len(keys) - ends[f + 1]
                    others = others[common[others] + np.minimum(rest[others], left) >= needed[others]]
                    if not len(others):
                        break
                if len(others):
                    _, first = np.unique(label[others], return_index=True)
                    links += [(own, k) for k in node[others[first]].tolist()]
            yield _batch(zip(*links) if links else [(), ()], (pa.int64(), pa.int64()), ["a", "b"])

    return settle.deal(rows, payload, "bytes", block_rows).mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, rounds: int = settle.ROUNDS,
                      block_rows: int = settle.BLOCK_ROWS, batch_grams: int = BATCH_GRAMS,
                      fragment_grams: int = FRAGMENT_GRAMS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``; other columns are not read.

    Words are runs without white space, A-Z lowered; a text of fewer words than
    ``width`` is one run of them all; a null text or one without words is linked
    with nothing. Rows with words that share a doc_id are one document: all that is
    linked with one of them is linked with the others. A null doc_id is its own
    component with a null component_id. An empty table gives no rows.
    """
    sizes = materialise(set_sizes(docs, width), "join-sizes")
    named = sizes.where("set_hi IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialise(named.groupBy("set_hi", "set_lo").agg(
        F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()), "join-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0

    def rows_named(ids: DataFrame) -> DataFrame:
        return docs.join(broadcast_if_small(ids, MAX_BROADCAST_IDS), F.col("doc_id").cast("long") == F.col("least"),
                         "left_semi")

    sharing = materialise(shared_counts(rows_named(classes.select("least")), total, width, percent, batch_grams,
                                        fragment_grams)
                          .withColumnRenamed("doc_id", "least").distinct(), "join-sharing")
    alive = materialise(classes.join(sharing.select("set_hi", "set_lo", "least"), ["set_hi", "set_lo", "least"],
                                     "left_semi"), "join-alive")
    lists = gram_lists(rows_named(alive.select("least")), width).withColumnRenamed("doc_id", "least")
    lists = materialise(lists.dropDuplicates(["least", "set_hi", "set_lo"])
                        .join(alive, ["least", "set_hi", "set_lo"]).select("node", "n", "grams"), "join-grams")
    sets = materialise(ordered_sets(lists, percent), "join-sets")
    cuts = cut_points(sets)
    pieces = materialise(segments(sets, cuts), "join-segments")
    buckets = settle.distinct_buckets(
        sets.select("node", F.explode(F.slice("keys", F.lit(1), F.col("prefix"))).alias("bucket")), "join")
    labels = settle.settle(buckets, lambda pairs: verified(pairs, sets, pieces, percent),
                           lambda rows: block_links(rows, sets, cuts, percent, block_rows), "join", rounds)
    return settle.named_components(sizes, classes, labels)
