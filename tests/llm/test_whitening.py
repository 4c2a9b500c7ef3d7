"""Whitening against plain numpy and plain integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from askgrid.llm import whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, component int").repartition(3)


def sample(n, size, seed=5):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, size)) @ rng.normal(size=(size, size)) * 0.1


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 1 << 20, (300, 5)) >> np.array([0, 3, 11, 20, 20])
    bits = [int(c.max()).bit_length() for c in y.T]
    found = whitening.cross_counts(y, bits)
    for i in range(5):
        for j in range(i, 5):
            assert found[i][j] == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j]))
    assert whitening.cross_counts(np.full((3, 1), (1 << 61) - 1), [61]) == [[3 * ((1 << 61) - 1) ** 2]]


def test_equals_plain_computation(spark):
    data = sample(400, 20).astype(np.float32)
    rows = [(i, v.tolist(), "s", 1) for i, v in enumerate(data)]
    rows += [(1000 + i, data[0].tolist(), "s", 1) for i in range(150)]  # one very common vector
    rows += [(2000, None, "s", 1), (2001, [None] * 20, "s", 1), (2002, [float("nan")] * 20, "s", 1),
             (2003, [float("inf")] * 20, None, None), (2004, [], "s", 1), (2005, [0.5], "s", 1),
             (None, data[1].tolist(), "s", 1)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    kept = [(i, np.array(v)) for i, v, *_ in rows if v and len(v) == 20 and None not in v and all(map(math.isfinite, v))]
    x = [tuple(int(math.floor(64 * float(c))) + 1_000_000 for c in v) for _, v in kept]
    fit = np.array(sorted(set(x)))
    n, sums = len(fit), [sum(map(int, c)) for c in fit.T]
    exact = [[sum(map(int, fit[:, i] * fit[:, j])) * n - sums[i] * sums[j] for j in range(20)] for i in range(20)]
    values = np.linalg.eigvalsh(np.array([[float(Fraction(v, n * n)) for v in row] for row in exact]))[::-1]
    assert len(found) == 16 * len(kept) and {r.n for r in found} == {n}
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, {})[r.component] = r
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert 0 <= r.identity_error <= 1e-6
    white, weights = {}, []
    for (i, _), own in zip(kept, x):
        line = by_row[i]
        assert sorted(line) == list(range(1, 17))
        assert line[1].deviation == sum((n * v - s) ** 2 for v, s in zip(own, sums))
        white.setdefault(own, [line[k].whitened for k in range(1, 17)])
        weights.append((i, own))
    matrix = np.array([white[own] for own in white])
    assert np.abs(np.cov(matrix.T, bias=True) - np.eye(16)).max() < 1e-8
    # Components are eigenvectors: projecting back gives V v = e v.
    centred = np.array([[v - s / n for v, s in zip(own, sums)] for own in white])
    axes = centred.T @ matrix / n
    axes = axes / np.linalg.norm(axes, axis=0)
    cov = centred.T @ centred / n
    assert np.abs(cov @ axes - axes * values[:16]).max() < 1e-7 * values[0]
    repeated = {tuple(by_row[i][k].whitened for k in range(1, 17)) for i in [0, *range(1000, 1150)]}
    assert len(repeated) == 1


@pytest.mark.parametrize("rows", [[], [(1, None, "s", 1)], [(1, [0.5, 0.25], "s", 1), (2, [0.5, 0.25], "s", 1)]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(vectors(spark, rows))
    assert found.collect() == []
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_far_values_and_few_dimensions(spark):
    rows = [(i, [3e38 if i == 0 else float(i), float(i % 3)], "s", 1) for i in range(20)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert len(found) == 20 and all(math.isfinite(r.whitened) for r in found)
    assert {r.vec_id for r in found if r.deviation is None} == set(range(20))
