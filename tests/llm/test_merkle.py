"""Fingerprints: the order of documents, the edit, equality and likeness."""

import hashlib
import re

import pytest
import xxhash
from fixtures import documents, empty, words
from pyspark.sql import functions as F

from askgrid.llm import merkle

TEXTS = [(i * 37 % 101, words(i * i % 90, i) + ("\n" + words(40, i)) * (i % 5)) for i in range(80)]
TEXTS += [(200, None), (201, "ü" * 7), (10 ** 15, "far away " * 30), (202, ""), (203, words(30, 200)), (204, words(30, 200))]


@pytest.mark.parametrize("bucket_bytes", [300, 10 ** 9])
def test_next_document_in_descending_order(spark, bucket_bytes):
    rows = merkle.with_next_text(documents(spark, TEXTS), bucket_bytes).collect()
    ordered = sorted(((i, t or "") for i, t in TEXTS), reverse=True)
    expected = {i: (t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered)}
    assert {r.doc_id: (r.text, r.next_text) for r in rows} == expected and len(rows) == len(TEXTS)


def test_edits_and_likeness(spark):
    rows = {r.doc_id: r for r in merkle.fingerprint_edits(documents(spark, TEXTS)).collect()}
    ordered = sorted(((i, t or "") for i, t in TEXTS), reverse=True)
    better = 0
    for k, (doc_id, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        row = rows[doc_id]
        assert (row.n_chars, row.edited) == (len(text), edited)
        assert (row.fingerprint == row.edited_fingerprint) == (text == edited)
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        better += row.near_edited > row.near_next or text == after
        if len(text) > 60 and text != edited:
            assert 0.4 < row.near_edited < 1
    assert better >= len(TEXTS) - 6
    assert rows[203].fingerprint == rows[204].fingerprint and rows[204].near_next == 1.0
    assert rows[200].fingerprint == rows[202].fingerprint


def leaves(pieces):
    return "".join(f"{xxhash.xxh64(piece.encode(), seed=42).intdigest() & 0xFFFFFFFF:08X}" for piece in pieces)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(text):
    """Root digest, and the branches as (digest or None, leaves)."""
    head, lines = text[:64], text[64:].split("\n")
    digests, branches = [], [(None, leaves(head[i:i + 8] for i in range(0, len(head), 8)))]
    for i in range(0, len(lines), 8):
        section = lines[i:i + 8]
        digests.append(sha("".join(map(sha, section))))
        branches.append((digests[-1][:16], "".join(leaves(re.findall(
            r"(?a)\s*(?:\S+\s*){1,4}|\s+", line)) for line in section)))
    return sha(sha(head) + "".join(digests)), branches


def plain_likeness(one, two):
    if one[0] == two[0]:
        return 1.0
    a, b = set(one[1]), set(two[1])

    def below(branches):
        return {text[i:i + 8] for _, text in branches for i in range(0, len(text), 8)}

    settled = sum(len(text) // 8 for _, text in a & b)
    mine, other = below(a - b), below(b - a)
    total = 2 * settled + len(mine) + len(other)
    return 2 * (settled + len(mine & other)) / total if total else 0.0


def test_whole_result_equals_a_plain_tree(spark):
    long = "\n".join(words(9, i) for i in range(90))
    texts = [*TEXTS, (300, long), (301, "first line\n" + long), (302, long + "\nlast"), (303, "  \n" * 30)]
    rows = {r.doc_id: r for r in merkle.fingerprint_edits(documents(spark, texts)).collect()}
    ordered = sorted(((i, t or "") for i, t in texts), reverse=True)
    for k, (doc_id, text) in enumerate(ordered):
        after, row = ordered[(k + 1) % len(ordered)][1], rows[doc_id]
        trees = [plain_tree(item) for item in (text, row.edited, after)]
        root, branches = trees[0]
        assert row.fingerprint == "/".join([root, branches[0][1], *(":".join(b) for b in branches[1:])])
        assert row.near_edited == pytest.approx(plain_likeness(trees[0], trees[1]))
        assert row.near_next == pytest.approx(plain_likeness(trees[0], trees[2]))
        most = max(len(trees[0][1]), len(trees[1][1]))
        assert row.changed_branches == ([] if text == row.edited else [
            at for at in range(most) if trees[0][1][at:at + 1] != trees[1][1][at:at + 1]])


def test_null_and_repeated_ids(spark):
    odd = [(None, "a b c"), (None, None), (4, "x y"), (4, "x y"), (4, "other"), (3, "z")]
    rows = merkle.with_next_text(documents(spark, odd), 4).collect()
    ids = [r.doc_id for r in rows]
    assert len(rows) == 6 and ids.count(4) == 3 and ids.count(None) == 2
    assert sorted(r.next_text for r in rows) == sorted(t or "" for _, t in odd)
    assert merkle.fingerprint_edits(documents(spark, odd)).count() == 6
    one = merkle.with_next_text(documents(spark, [(9, "solo")])).collect()
    assert [(r.text, r.next_text) for r in one] == [("solo", "solo")]
    assert merkle.fingerprint_edits(empty(spark)).count() == 0


def test_root_tells_texts_apart_and_branches_locate_edits(spark):
    base = "\n".join(words(12, i) for i in range(40))
    lines = base.split("\n")
    changed = "\n".join([*lines[:20], "new line", *lines[21:]])
    texts = [base, changed, base + "\n", base.replace(" ", "  ", 1), "", "\n", "\n\n", " ", "\n "]
    frame = merkle.add_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "f")
    prints = [r.f for r in frame.orderBy("i").collect()]
    assert len({p[:64] for p in prints}) == len(texts)
    pair = spark.createDataFrame([(prints[0], prints[1])], "a string, b string")
    assert pair.select(merkle.changed_branches(F.col("a"), F.col("b"))).first()[0] == [3]
