"""Token files and packing against whole-text tokenising and plain dynamic programming."""

import random

import numpy as np
import pytest
from fixtures import documents, empty, texts, words

from askgrid.llm import packing, token_files, tokens


def encode(text, end):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def in_order(end):
    rows = [(i, encode(t, end)) for i, t in texts()]
    return sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, np.array(row[1], "<u2").tobytes()))


def test_cached_words_give_the_ids_of_whole_texts():
    encoder = tokens.CachedEncoder(tokens.default_tokenizer())
    assert encoder.by_word and encoder.folds_case
    odd = ["it's we'll I'D", "a.b, c.. 'd,", "e\u0301x E\u0301X", "1st 22nd", "x\u00a0y\u2003z", "ΣΑΣ ς", "İI",
           "<|endoftext|>x <|ENDOFTEXT|>", "... , .", "don't,", "ab'.", "٣.", "日本語。テスト", "straße ÖL öl ﬁn Ǆ ǆ", "ά ς ΐ", "e\u0301clair éclair", "naïve\u0301", "ʼn ŉ"]
    odd += [text or "" for _, text in texts()]
    found = list(encoder.encode([text.encode() for text in odd]))
    for text, ids in zip(odd, found):
        assert np.frombuffer(ids, encoder.dtype).tolist() == encode(text, 0)[:-1], text


def test_case_is_folded_after_marks_are_composed():
    encoder = tokens.CachedEncoder(tokens.default_tokenizer())
    pairs = ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"]
    odd = [f"{before}{pair}anukkah and {pair}. A{pair.lower()}, PLAIN" for pair in pairs for before in ("", "The ")]
    odd += [*pairs, "no marks HERE", "<|endoftext|> " + pairs[0] + "x"]
    for batch in (odd, odd[:-1]):
        for text, ids in zip(batch, encoder.encode([text.encode() for text in batch])):
            assert np.frombuffer(ids, encoder.dtype).tolist() == encode(text, 0)[:-1], text


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 80)
    encoder = tokens.CachedEncoder(tokens.default_tokenizer())
    many = [words(30, seed) + ", " + words(5, 1) + "." for seed in range(20)]
    for _ in range(3):
        for text in many:
            (ids,) = encoder.encode([text.encode()])
            assert np.frombuffer(ids, encoder.dtype).tolist() == encode(text, 0)[:-1]
    assert len(encoder.known) < 200


@pytest.mark.parametrize("limit", [3, 4, 6, 12])
def test_code_lengths_are_optimal_and_limited(limit):
    for seed in range(5):
        rng = random.Random(seed)
        counts = {i: rng.randint(1, 10 ** rng.randint(1, 5)) for i in range(7)}
        lengths = token_files.code_lengths(counts, limit)
        assert max(lengths.values()) <= limit
        assert sum(2.0 ** -bits for bits in lengths.values()) <= 1

        def best(left, space, worst=limit):
            """Least cost of symbols in descending count with Kraft sum at most ``space``."""
            if not left:
                return 0
            return min((left[0] * bits + best(left[1:], space - 2 ** (limit - bits))
                        for bits in range(1, limit + 1)
                        if space - 2 ** (limit - bits) >= len(left) - 1), default=float("inf"))
        cost = sum(counts[i] * bits for i, bits in lengths.items())
        if limit <= 4:
            assert cost == best(sorted(counts.values(), reverse=True), 2 ** limit)


def test_blocks_decode_from_every_checkpoint():
    rng = np.random.default_rng(1)
    for n in (1, 255, 256, 257, 5000):
        ids = np.minimum(rng.geometric(0.01, n), 3000)
        code = token_files.Code(token_files.code_lengths(
            {int(k): int(v) for k, v in zip(*np.unique(ids, return_counts=True))}))
        payload, marks = code.encode(ids)
        assert code.decode(payload, marks, n).tolist() == ids.tolist()
        last = len(marks) - 1
        assert code.decode(payload, marks[last:], n - 256 * last).tolist() == ids[256 * last:].tolist()


def test_token_files_round_trip(spark):
    files = token_files.write_token_files(documents(spark), block_tokens=2000, partition_bytes=30_000)
    assert files[0].count() > 5
    found = [tuple(row) for row in token_files.read_token_files(*files).collect()]
    at, expected = 0, []
    for doc_id, ids in in_order(2):
        expected.append((doc_id, at, len(ids), bytearray(raw(ids))))
        at += len(ids)
    assert sorted(found, key=lambda row: row[1]) == expected


def test_empty_tables(spark):
    assert token_files.read_token_files(*token_files.write_token_files(empty(spark))).count() == 0
    assert packing.pack(empty(spark)).count() == 0


def padding(start, end, last, length, tail):
    free = (end - start).bit_count() == 1 and end > last - tail
    return 0 if free else length - end + start


def plain_cost(places, penalties, length, window_cost, tail):
    best = {0: 0}
    for place, penalty in zip(places, penalties):
        best[place] = min((best[start] + penalty + window_cost + padding(start, place, places[-1], length, tail)
                           for start in best if 0 < place - start <= length))
    return best[places[-1]]


@pytest.mark.parametrize("tail", [0, 40, 1000])
def test_cuts_are_the_cheapest(tail):
    for seed in range(30):
        rng = np.random.default_rng(seed)
        places = np.cumsum(rng.integers(1, 12, 40))
        penalties = rng.integers(0, 9, 40)
        cuts = packing.choose_cuts(places, penalties, 16, 2, tail)
        cost = 0
        for start, end in zip([0, *cuts], cuts):
            assert end - start <= 16
            cost += 2 + penalties[places.tolist().index(end)] + padding(start, end, places[-1], 16, tail)
        assert cuts[-1] == places[-1]
        assert cost == plain_cost(places.tolist(), penalties.tolist(), 16, 2, tail)


def test_an_open_end_leaves_no_short_window_before_it():
    cuts = packing.choose_cuts(np.arange(1, 1001), np.ones(1000, int), 64, 4, goes_on=True)
    assert set(np.diff([0, *cuts[:-1]]).tolist()) == {64} and cuts[-1] == 1000


@pytest.mark.parametrize("partition_bytes", [20_000, 10 ** 9])
def test_pieces_hold_every_id_once(spark, partition_bytes):
    rows = packing.pack(documents(spark), partition_bytes=partition_bytes, segment_tokens=9000).collect()
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append(row)
    stream = []
    for _, pieces in sorted(sequences.items()):
        at = 0
        for piece in sorted(pieces, key=lambda row: row.offset):
            assert piece.offset == at and 0 < piece.length == len(piece.ids) // 4
            at += piece.length
            stream.append(piece)
        assert at <= 2048
    padded = sum(0 if n.bit_count() == 1 else 2048 - n for n in
                 (sum(piece.length for piece in pieces) for pieces in sequences.values()))
    assert padded <= 0.002 * sum(row.length for row in rows)
    expected = in_order(1)
    joined = b"".join(bytes(piece.ids) for piece in stream)
    assert joined == b"".join(raw(ids) for _, ids in expected)
    done = 0
    for doc_id, ids in expected:
        taken = 0
        while taken < len(ids):
            piece = stream[done]
            assert (piece.doc_id, piece.start, piece.doc_tokens) == (doc_id, taken, len(ids))
            taken, done = taken + piece.length, done + 1
        assert taken == len(ids)
