"""The prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from askgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string, n_convs long"


def conversations(spark, rows):
    return spark.createDataFrame([(*row, 1, "x", 2) for row in rows], SCHEMA).repartition(3)


def brute(rows):
    turns = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
        ends.setdefault(s, []).append(c)
    out = {}
    for node, own in members.items():
        inside = [u for u in members if u[:len(node)] == node]
        listed = ",".join(map(str, sorted(ends.get(node, []))))
        out[min(own), len(node)] = (
            min(members[node[:-1]]) if node else None, len(own),
            sum(len(u) == len(node) + 1 for u in inside),
            sum(not any(v[:-1] == u and v for v in inside) for u in inside),
            sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in inside if u),
            hashlib.sha256(listed.encode()).hexdigest())
    return out


def check(spark, rows, **options):
    found = prefix_trie.prefix_nodes(conversations(spark, rows), **options).collect()
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in found}
    assert len(got) == len(found)
    assert got == brute(rows)


def forest(seed, n, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"t{rng.randint(0, 2)}ü"))
    return rows


@pytest.mark.parametrize("small", [4096, 2])
def test_equals_brute_force(spark, small):
    rows = forest(1, 60)
    rows += [(500, turn, "user", f"long {turn}") for turn in range(30)]  # one long chain
    rows += [(600 + i, turn, "user", "same") for i in range(40) for turn in range(9)]  # one very common conversation
    check(spark, rows, small=small)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, 1, "user", None), (3, 1, "user", None),
            (3, 1, "assistant", ""), (7, 2, "user", "x" * 100_000), (-3, 0, "user", "neg"), (-5, 0, "user", "base"),
            (12, 0, "u", "one"), (14, 5, "u", "two")]
    check(spark, rows)
    check(spark, rows, small=1)
    assert prefix_trie.prefix_nodes(conversations(spark, [])).count() == 0


def test_centroids_in_a_task():
    rng = random.Random(4)
    for n in (1, 2, 30, 300):
        parents = [-1] + [rng.randint(max(0, i - 3), i - 1) for i in range(1, n)]
        values = [(rng.randint(0, 5), 1) for _ in range(n)]
        weights = [rng.randint(1, 4) for _ in range(n)]
        sums, below = [list(v) for v in values], list(weights)
        for i in range(n - 1, 0, -1):
            sums[parents[i]] = [a + b for a, b in zip(sums[parents[i]], sums[i])]
            below[parents[i]] += below[i]
        assert prefix_trie.centroid_totals(list(range(n)), parents, below, values) == sums
