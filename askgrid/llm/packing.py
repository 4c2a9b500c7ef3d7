"""Order-preserving packing of documents into fixed-length sequences.

The token stream of the documents, in doc_id order, is cut into windows of at
most ``length`` tokens. A cut may lie at a document end, after a sentence, or,
where neither is near enough, inside a sentence; each kind has a penalty in
tokens. A window costs its padding (none if its length is a power of two, for
such sequences are not padded), the penalty of the cut that ends it and a
small fixed cost. Dynamic programming over the cut places finds the cheapest
windows:

    best[j] = cut[j] + window_cost + min(length - at[j] + min(best[i] + at[i]),
                                         min over k of best[i with at[i] = at[j] - 2^k])

The inner minimum ranges over the places within ``length`` tokens before j. It
is a sliding minimum, kept in a monotone queue, so each place enters and
leaves the queue once. The powers of two are look-ups, made only at the end of
a stream, where the windows are short; elsewhere they would trade padding for
more and shorter sequences.

The stream is range partitioned by doc_id and each partition is packed in
segments of bounded length; the last window of a segment is carried over into
the next, so only the end of a partition can leave a short window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import materialise, task_count
from askgrid.llm.tokens import as_ids, default_tokenizer, token_table

LENGTH = 2048
WINDOW_COST = 4
SENTENCE_PENALTY = 1
INNER_PENALTY = 8
SEGMENT_TOKENS = 1 << 19
PARTITION_BYTES = 64 << 20
STOPS = (".", "!", "?", ".\"", "!\"", "?\"", ".)", "...", "!!", "!!!", "??", "。", "！", "？")
PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


def choose_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH,
                window_cost: int = WINDOW_COST, short_tail: int = 0, goes_on: bool = False) -> list[int]:
    """Cheapest cut places (ascending, the last one is the end) of a stream.

    ``places`` are ascending positive token positions that may end a window,
    the last one the end of the stream, at most ``length`` apart. Short
    windows that need no padding are tried in the last ``short_tail`` tokens.
    If the stream ``goes_on``, its last window is still open and costs nothing.
    """
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    ats, extra = [0, *places.tolist()], [0, *penalties.tolist()]
    best, came = [0] * len(ats), [0] * len(ats)
    index = {0: 0}
    find = index.get
    tail = ats[-1] - short_tail
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # best + at, at, index
    for j in range(1, len(ats)):
        at = ats[j]
        oldest = at - length
        while queue[0][1] < oldest:
            queue.popleft()
        key, _, origin = queue[0]
        least = key + length - at
        if at > tail:
            for power in powers:
                i = find(at - power)
                if i is not None and best[i] < least:
                    least, origin = best[i], i
        index[at] = j
        least += extra[j] + window_cost
        best[j], came[j] = least, origin
        key = least + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, at, j))
    if goes_on:
        end = len(ats) - 1
        came[end] = min((i for i in range(end) if ats[i] >= ats[end] - length), key=lambda i: (best[i], i))
    cuts, j = [], len(ats) - 1
    while j:
        cuts.append(ats[j])
        j = came[j]
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, final: bool,
               length: int = LENGTH, sentence: int = SENTENCE_PENALTY,
               inner: int = INNER_PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Places that may end a window, and their penalties.

    Gaps of a whole window or more get inner places all along, and so does the
    last window of a stream (``final``), which would else be padded.
    """
    n = len(ids)
    sentences = np.flatnonzero(np.isin(ids, stops)) + 1
    places = np.union1d(np.union1d(sentences, doc_ends), [n])
    gaps = np.diff(np.r_[0, places])
    wide = np.flatnonzero(gaps > length // 8)
    more = [np.arange(places[k] - gaps[k] + 1, places[k]) for k in wide]
    if final:
        more.append(np.arange(max(1, n - length), n))
    if more:
        places = np.union1d(places, np.concatenate(more))
    penalties = np.full(len(places), inner, np.int64)
    penalties[np.isin(places, sentences)] = sentence
    penalties[np.isin(places, doc_ends)] = 0
    penalties[-1] = 0
    return places, penalties


def _packer(stops: np.ndarray, length: int, segment: int):
    """Partition of (doc_id, ids, width, n_tokens) in order -> piece rows."""

    def emit(windows, pieces, sequence):
        """Pieces of a stream cut at ``windows``; pieces: (doc_id, ids, doc_tokens, done)."""
        rows, bounds = [], iter(windows)
        end, at, begun = next(bounds), 0, 0
        for doc_id, ids, total, done in pieces:
            taken = 0
            while taken < len(ids) and end is not None:
                take = min(len(ids) - taken, end - at)
                rows.append((doc_id, done + taken, take, total, sequence, at - begun,
                             ids[taken:taken + take].astype("<u4").tobytes()))
                taken, at = taken + take, at + take
                if at == end:
                    begun, sequence, end = end, sequence + 1, next(bounds, None)
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), sequence

    def remainder(pieces, cut):
        """What lies behind position ``cut``."""
        left, at = [], 0
        for doc_id, ids, total, done in pieces:
            skip = min(max(cut - at, 0), len(ids))
            at += len(ids)
            if skip < len(ids):
                left.append((doc_id, ids[skip:], total, done + skip))
        return left

    def plan(pieces, final):
        stream = np.concatenate([ids for _, ids, _, _ in pieces])
        ends = np.cumsum([len(ids) for _, ids, _, _ in pieces])
        whole = np.array([done + len(ids) == total for _, ids, total, done in pieces])
        places, penalties = cut_places(stream, ends[whole], stops, final, length)
        return choose_cuts(places, penalties, length, short_tail=2 * length if final else 0, goes_on=not final)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sequence = TaskContext.get().partitionId() << 33
        pieces, held = [], 0
        for batch in batches:
            for doc_id, raw, width, total in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, done = as_ids(raw, width), 0
                while done < len(ids):
                    take = min(len(ids) - done, segment - held)
                    pieces.append((doc_id, ids[done:done + take], total, done))
                    done, held = done + take, held + take
                    if held == segment:
                        windows = plan(pieces, False)[:-1]
                        rows, sequence = emit(windows, pieces, sequence)
                        yield rows
                        pieces = remainder(pieces, windows[-1])
                        held -= windows[-1]
        if pieces:
            rows, sequence = emit(plan(pieces, True), pieces, sequence)
            yield rows

    return run


def stop_ids(path: str) -> np.ndarray:
    """Ids of the tokens that end a sentence."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    found = [tokenizer.encode(mark, add_special_tokens=False).ids for mark in STOPS]
    return np.array(sorted({ids[0] for ids in found if len(ids) == 1}))


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = 1,
         tokenizer_path: str | None = None, partition_bytes: int = PARTITION_BYTES,
         segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Pieces of all texts in sequences of at most ``length`` tokens.

    ``docs`` has doc_id and text; a null text is empty and gives one piece,
    the end id. Returns (doc_id, start, length, doc_tokens, sequence_id,
    offset, ids): the piece begins ``start`` ids into its document and
    ``offset`` ids into its sequence; ``ids`` are little-endian unsigned 32-bit.
    Rows with one doc_id are separate documents, ordered by their ids' bytes;
    null doc_ids come first. ``sequence_id`` is unique and ascends with the
    stream, with gaps between partitions. An empty table gives no pieces.
    """
    path = tokenizer_path or default_tokenizer()
    if segment_tokens < 4 * length:
        raise ValueError("A segment must hold several sequences")
    tokens = materialise(token_table(docs, end_id, path), "packing-tokens")
    parts = task_count(tokens, "ids", partition_bytes)
    # Rows of one doc_id, or without one, are spread by how their ids begin.
    return (tokens.select("doc_id", "ids", "width", "n_tokens")
            .repartitionByRange(parts, "doc_id", F.substring("ids", 1, 32)).sortWithinPartitions("doc_id", "ids")
            .mapInArrow(_packer(stop_ids(path), length, segment_tokens), PIECES))
