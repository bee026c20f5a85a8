"""Nearest neighbours against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from wardbook.llm import neighbours


def plain(rows, queries, k=10):
    out = {}
    ids = np.array([i for i, _ in rows])
    held = np.array([v for _, v in rows], dtype=np.float64)
    for q in queries:
        own = held[ids == q][0]
        gap = np.sqrt(((held - own) ** 2).sum(axis=1))
        order = [j for j in np.lexsort([ids, gap]) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(gap[j])) for j in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def test_recall_over_the_given_table(spark):
    path = str(TESTDATA).replace("sf0.001", "sf0.1") + "/embeddings.parquet"
    vectors = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    queries = [i for i, _ in rows if i % 20 == 0]
    got = found(neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), list_size=50, probes=16))
    want = plain(rows, queries)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in queries)
    assert hits >= 0.9 * 10 * len(queries)
    scores = {(q, i): s for q in queries for i, s in plain(rows, [q], len(rows))[q]}
    for q in queries:
        assert len(got[q]) == 10
        assert all(s == pytest.approx(scores[q, i], abs=1e-12) for i, s in got[q])


def test_ties_copies_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40, 10, -1)] + [(100, [0.0, 1.0]), (7, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = frame.where("vec_id in (7, 20, 100)")
    assert found(neighbours.search(frame, asked)) == plain(rows, [7, 20, 100])
    few = [(1, [1.0]), (2, [2.0]), (3, [2.0])]
    frame = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert found(neighbours.search(frame, frame)) == plain(few, [1, 2, 3])


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0])]
    rows += [(6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (2, [1.0, 2.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(neighbours.search(frame, frame)) == {1: [(2, 0.5)], 2: [(1, 0.5)]}
    empty = frame.limit(0)
    assert neighbours.search(empty, empty).count() == 0
    assert neighbours.search(frame, frame.where("vec_id = 4")).count() == 0


def test_every_vector_is_indexed_and_lists_are_even():
    draw = np.random.default_rng(1)
    rows = np.concatenate([draw.normal(size=(900, 8)) * 0.05, draw.normal(size=(100, 8))])
    index = neighbours.fit(rows, 20)
    places, gaps = index.nearest(rows, 4)
    assert places.shape == (1000, 4) and (np.diff(gaps, axis=1) >= 0).all()
    exact = neighbours._distances(rows, index.centroids).argmin(axis=1)
    assert np.mean(places[:, 0] == exact) >= 0.95
    assert np.bincount(places[:, 0], minlength=20).max() <= 250


def test_recall_where_lists_are_many_and_small(spark):
    """800 lists, of which a query reads a seventh at most; odd extra columns are not read."""
    given = spark.read.parquet(f"{TESTDATA}/../sf0.1/embeddings.parquet").orderBy("vec_id")
    base = np.array([r.embedding for r in given.collect()], dtype=float)
    draw = np.random.default_rng(0)
    rows = np.vstack([base, *(base + draw.normal(0, 0.3 * base.std(), base.shape) for _ in range(3))])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    frame = frame.repartition(8).withColumns({c: F.lit(1) for c in ("list", "rep", "score", "rank", "place")})
    found = {}
    for r in neighbours.search(frame, frame.where("vec_id % 50 = 0"), list_size=10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for query, near in found.items():
        gaps = ((rows - rows[query]) ** 2).sum(axis=1)
        gaps[query] = np.inf
        hits += len(near & set(np.argsort(gaps, kind="stable")[:10].tolist()))
    assert len(found) == 160 and hits / 1600 >= 0.93
