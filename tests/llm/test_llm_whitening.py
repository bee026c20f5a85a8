"""Whitening against a dense solution in numpy, and the eigenvalue solver alone."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardbook.llm.feast import count_above, intervals, largest
from wardbook.llm.whitening import LIMIT, exact_products, whiten

DRAW = np.random.default_rng(3)


def spectrum(values):
    turn, _ = np.linalg.qr(np.random.default_rng(8).standard_normal((len(values), len(values))))
    matrix = turn * np.array(values, dtype=float) @ turn.T
    return (matrix + matrix.T) / 2


MATRICES = {
    "spread": spectrum(np.linspace(0.1, 9, 40)),
    "clusters": spectrum(np.repeat([1, 2, 3, 4, 5.0], 8)),
    "one value": spectrum([2.0] * 30),
    "near": spectrum(1 + 1e-9 * np.arange(40)),
    "falling": spectrum(10.0 ** -np.arange(30)),
    "low rank": spectrum([9, 4, 4, 1e-3] + [0] * 20),
    "tiny": spectrum([3.0]),
}


@pytest.mark.parametrize("name", sorted(MATRICES))
def test_largest_eigenpairs(name):
    matrix = MATRICES[name]
    true = np.linalg.eigvalsh(matrix)[::-1]
    values, vectors = largest(matrix, 16)
    scale = true[0]
    positive = int((true > len(matrix) * 1e-15 * scale).sum())
    assert min(16, len(matrix)) >= len(values) >= min(16, positive) - (name == "falling")
    assert np.abs(values - true[: len(values)]).max() < 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 4e-12 * scale


def test_inertia_counts_eigenvalues():
    for matrix in MATRICES.values():
        true = np.linalg.eigvalsh(matrix)
        for shift in np.linspace(-1, 10, 30) + 0.0123:
            assert count_above(matrix, shift) == (true > shift).sum()
    assert count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert count_above(np.zeros((3, 3)), 0.0) == 0


def test_intervals_hold_what_the_inertia_says():
    matrix = MATRICES["spread"]
    found = intervals(matrix, 20)
    assert sum(count for _, _, count in found) == 20
    assert all(count_above(matrix, low) - count_above(matrix, high) == n for low, high, n in found)
    assert intervals(np.zeros((4, 4)), 3) == []


def test_products_are_exact():
    small = DRAW.integers(-70, 70, (500, 6))
    large = DRAW.integers(-(2**40), 2**40, (20, 4))
    middle = DRAW.integers(-(2**25), 2**25, (300, 3))
    for rows in (small, large, middle):
        wide = rows.astype(object)
        assert exact_products(rows) == (wide.T @ wide).tolist()


def counted(vector):
    bound = [max(-LIMIT, min(LIMIT, 64 * c)) for c in vector]
    return tuple(math.floor(c) + 1_000_000 for c in bound)


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def compare(spark, rows, kind="float", components=16, extra=None):
    docs = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    if extra:
        docs = docs.withColumns(extra)
    rows = [tuple(r) for r in docs.select("vec_id", "embedding").collect()]
    found = [r.asDict() for r in whiten(docs, components).collect()]
    kept = [(i, counted(v)) for i, v in rows if usable(v)]
    expected_rows = 0
    for size in {len(x) for _, x in kept}:
        own = [(i, x) for i, x in kept if len(x) == size]
        distinct = sorted({x for _, x in own})
        n, total = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
        if n < 2 or not size:
            continue
        exact = [[n * a - s for a, s in zip(x, total, strict=True)] for x in distinct]
        centred = np.array([[float(a / n) for a in row] for row in exact])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        width = min(components, int((values > 1e-12 * values[-1]).sum()))
        values, vectors = values[::-1][:width], vectors[:, ::-1][:, :width]
        here = [r for r in found if r["n"] == n and len([1 for q in own if q[0] == r["vec_id"]])]
        assert {r["component"] for r in here} == set(range(1, width + 1))
        expected_rows += width * len(own)
        for vec_id, x in own:
            far = [n * a - s for a, s in zip(x, total, strict=True)]
            mine = [r for r in here if r["vec_id"] == vec_id]
            deviation = sum(a * a for a in far)
            assert {r["deviation"] for r in mine} == {deviation if deviation < 2**63 else None}
            for r in mine:
                k = r["component"] - 1
                true = np.array([a / n for a in far]) @ vectors[:, k] / math.sqrt(values[k])
                assert abs(abs(r["whitened"]) - abs(true)) < 1e-6
                assert abs(r["explained"] / (values[k] / np.trace(centred.T @ centred / n)) - 1) < 1e-7
    assert len(found) == expected_rows
    assert all(r["identity_error"] < 1e-6 for r in found)
    return found


def vectors(n, size, seed=0):
    draw = np.random.default_rng(seed)
    return [(i, (draw.standard_normal(size) * np.linspace(1, 2, size)).tolist()) for i in range(n)]


def test_against_numpy(spark):
    found = compare(spark, vectors(300, 24), extra={"n": F.lit(5), "x": F.lit("a"), "size": F.lit(1)})
    # The sign of a component is the same for all rows.
    first = {r["vec_id"]: r["whitened"] for r in found if r["component"] == 1}
    assert abs(np.mean(list(first.values()))) < 1e-9 and abs(np.std(list(first.values())) - 1) < 1e-9


def test_odd_rows(spark):
    """Nulls, non-finite and zero entries, repeated rows, a hot vector, other lengths."""
    rows = vectors(120, 5) + [(1000 + i, [0.5, 0.0, -0.5, 1.0, 2.0]) for i in range(200)]
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 5)]
    rows += [(2003, [1.0, float("inf"), 1.0, 1.0, 1.0]), (2004, []), (3, rows[3][1]), (None, [0.0] * 5)]
    rows += [(3000 + i, v) for i, v in vectors(40, 3, seed=9)] + [(4000, [1.0, 2.0])]
    compare(spark, rows)


def test_fewer_components_and_constant_dimensions(spark):
    rows = [(i, [*v, 7.0, 7.0]) for i, v in vectors(60, 3)]
    assert {r["component"] for r in compare(spark, rows)} == {1, 2, 3}
    assert {r["component"] for r in compare(spark, rows, components=2)} == {1, 2}


def test_numbers_too_large_for_a_long(spark):
    rows = [(i, [c * 1e6 for c in v]) for i, v in vectors(50, 4)] + [(99, [1e300, -1e300, 0.0, 1.0])]
    found = compare(spark, rows, kind="double")
    assert any(r["deviation"] is None for r in found)


def test_nothing_to_fit(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whiten(spark.createDataFrame(rows, schema)).count() == 0
