"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardbook.llm.shared import staged
from wardbook.operators.keyed import left_join_unique

#: Vectors the centroids are fitted on at most; those of the smallest hashes.
SAMPLE = 40_000
#: Vectors a list should hold, and the most centroids, whose size bounds the broadcast.
LIST_SIZE = 400
MAX_LISTS = 8_192
#: Lists a vector is written to at most, and how much farther than the nearest they may be.
COPIES = 4
COPY_RATIO = 1.15
#: Lists a query reads at most: so many, or so many times the root of the number of lists where
#: that is more; and how much farther than the nearest they may be.
PROBES = 48
PROBES_BY_ROOT = 4
PROBE_RATIO = 2.0
#: Vectors of one list that are compared in one task.
PART = 4_000
#: Neighbours of a centroid in the graph, and the beam that walks it.
DEGREE = 24
BEAM = 24


@dataclass(frozen=True)
class Index:
    """Centroids and a graph over them; ``graph`` row i holds the neighbours of i."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def nearest(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``k`` near centroids of each row and their distances, by a walk of the graph."""
        k = min(k, len(self.centroids))
        places, gaps = np.zeros((len(rows), k), dtype=np.int64), np.zeros((len(rows), k))
        first = _distances(rows, self.centroids[self.entries])
        for i, row in enumerate(rows):
            found = self._walk(row, first[i], max(BEAM, 2 * k))[:k]
            places[i], gaps[i] = [p for _, p in found], [d for d, _ in found]
        return places, gaps

    def _walk(self, row: np.ndarray, first: np.ndarray, beam: int) -> list[tuple[float, int]]:
        """Best-first search: follow the nearest open centroid until all of a full beam is nearer."""
        start = np.argsort(first, kind="stable")[:4]
        todo = [(float(first[j]), int(self.entries[j])) for j in start]
        seen = {p for _, p in todo}
        best = [(-d, p) for d, p in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            gap, at = heapq.heappop(todo)
            if len(best) >= beam and gap > -best[0][0]:
                break
            new = [p for p in self.graph[at].tolist() if p not in seen]
            if not new:
                continue
            seen.update(new)
            gaps = np.sqrt(((self.centroids[new] - row) ** 2).sum(axis=1)).tolist()
            for d, p in zip(gaps, new, strict=True):
                if len(best) < beam or d < -best[0][0]:
                    heapq.heappush(todo, (d, p))
                    heapq.heappush(best, (-d, p))
                    if len(best) > beam:
                        heapq.heappop(best)
        # Centroids the graph does not reach fill up a short beam.
        if len(best) < min(beam, len(self.centroids)):
            gaps = np.sqrt(((self.centroids - row) ** 2).sum(axis=1))
            return [(float(gaps[p]), int(p)) for p in np.argsort(gaps, kind="stable")[:beam]]
        return sorted((-d, p) for d, p in best)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def fit(rows: np.ndarray, lists: int, rounds: int = 8) -> Index:
    """Centroids by k-means whose clusters are kept even, and the graph of their neighbours.

    In each round a cluster's distances are raised with its size, so that large ones give
    rows to their neighbours.
    """
    draw = np.random.default_rng(11)
    lists = max(1, min(lists, len(rows)))
    centroids = rows[draw.choice(len(rows), lists, replace=False)].copy()
    even, penalty = len(rows) / lists, np.zeros(lists)
    for _ in range(rounds):
        total, count = np.zeros_like(centroids), np.zeros(lists)
        spread = 0.0
        for at in range(0, len(rows), 2048):
            part = rows[at : at + 2048]
            gaps = _distances(part, centroids)
            own = (gaps + penalty).argmin(axis=1)
            spread += float(gaps[np.arange(len(part)), own].sum())
            np.add.at(total, own, part)
            count += np.bincount(own, minlength=lists)
        penalty = 0.1 * spread / len(rows) * np.log1p(np.maximum(count / even - 1, 0))
        full = count > 0
        centroids[full] = total[full] / count[full, None]
        empty = np.flatnonzero(~full)
        centroids[empty] = rows[draw.choice(len(rows), len(empty))]
    degree = min(DEGREE, lists - 1)
    graph = np.zeros((lists, degree), dtype=np.int32)
    for at in range(0, lists, 1024) if degree else ():
        gaps = _distances(centroids[at : at + 1024], centroids)
        gaps[np.arange(len(gaps)), np.arange(at, at + len(gaps))] = np.inf
        graph[at : at + 1024] = np.argpartition(gaps, degree - 1, axis=1)[:, :degree]
    entries = draw.choice(lists, min(lists, 4 * math.isqrt(lists) + 1), replace=False)
    return Index(centroids, graph, np.sort(entries))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector``: one row per id, with vectors that can be compared.

    Left out are null ids, vectors that are null, zero, or hold a null or non-finite
    component, and those of another length than most (of equally frequent lengths the
    longer counts). Of several vectors of one id the smallest counts.
    """
    numbers = F.col("embedding").cast("array<double>")
    finite = F.forall(
        numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    fit_for_use = (
        F.col("vec_id").isNotNull()
        & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists(numbers, lambda x: x != 0), F.lit(False))
    )
    good = vectors.where(fit_for_use).select("vec_id", numbers.alias("vector"))
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n"))
    most = length.first()
    good = good.where(F.size("vector") == (most.n if most else 0))
    return good.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _assign(rows: DataFrame, index, copies: int, ratio: float) -> DataFrame:
    """``list, rep, vector``: each vector in its nearest list and others about as near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places, gaps = index.value.nearest(_matrix(batch.column("vector")), copies)
            near = gaps <= gaps[:, :1] * ratio
            at = np.nonzero(near)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(places[near].astype(np.int32)),
                    batch.column("rep").take(pa.array(at)),
                    batch.column("vector").take(pa.array(at)),
                ],
                names=["list", "rep", "vector"],
            )

    return rows.select("rep", "vector").mapInArrow(run, "list int, rep long, vector array<double>")


def _probe(queries: DataFrame, index, sizes, probes: int, ratio: float, least: int) -> DataFrame:
    """``list, part, rep, vector``: each query at every part of the lists it reads.

    Lists farther than ``ratio`` times the nearest are left out, unless those nearer hold
    fewer than ``least`` vectors.
    """

    def chosen(places: np.ndarray, gaps: np.ndarray, held: np.ndarray) -> np.ndarray:
        before = np.cumsum(held[places], axis=1) - held[places]
        return (gaps <= gaps[:, :1] * ratio) | (before < least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = sizes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("vector"))
            places, gaps = index.value.nearest(rows, probes)
            if (held[places].sum(axis=1) < least).any():
                places, gaps = index.value.nearest(rows, len(held))
            at, which = np.nonzero(chosen(places, gaps, held))
            lists = places[at, which]
            times = parts[lists]
            number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            again = pa.array(np.repeat(at, times))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(lists, times).astype(np.int32)),
                    pa.array(number.astype(np.int32)),
                    batch.column("rep").take(again),
                    batch.column("vector").take(again),
                ],
                names=["list", "part", "rep", "vector"],
            )

    return queries.select("rep", "vector").mapInArrow(
        run, "list int, part int, rep long, vector array<double>"
    )


def _compare(k: int):
    """The ``k`` nearest vectors of one part of a list to each query that reads it."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        asked, names, gaps = [], [], []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("rep", kind="stable")
            held, reps = np.stack(vectors["vector"].to_numpy()), vectors["rep"].to_numpy()
            for row, rep in zip(queries["vector"], queries["rep"], strict=True):
                gap = np.sqrt(((held - row) ** 2).sum(axis=1))
                best = np.argsort(gap, kind="stable")[:k]
                asked += [rep] * len(best)
                names += reps[best].tolist()
                gaps += gap[best].tolist()
        return pd.DataFrame({"query": asked, "rep": names, "score": gaps}).astype(
            {"query": "int64", "rep": "int64", "score": "float64"}
        )

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    list_size: int = LIST_SIZE,
    probes: int | None = None,
    bound: int = SAMPLE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query.

    ``vectors`` has ``vec_id`` and ``embedding``, ``queries`` the ``vec_id`` of rows that
    ask. Scores are Euclidean distances in double precision on the vectors as given; ties go
    to the smaller id, and a query is not its own neighbour. Fewer candidates than ``k``
    are all returned.

    Equal vectors are indexed once, with their ``k + 1`` smallest ids: more can be in no
    answer. Centroids are fitted on at most ``bound`` vectors; every vector is then written to
    its nearest lists, those at a boundary to several. The index itself is bounded by
    ``MAX_LISTS``, so it may be broadcast; lists are split into parts of ``PART`` vectors.
    A query reads more lists where there are more, up to the distance ratio. Other columns,
    whatever their names, are not read.

    Rows that ``usable`` leaves out take no part. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors), "vectors")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = (
        rows.withColumn("place", place)
        .where(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("rep"), "ids", "vector")
    )
    distinct = staged(distinct, "distinct")
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("vector"), "rep").limit(bound).select("vector").toArrow()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = _matrix(sample.column("vector").combine_chunks())
    lists = min(math.ceil(n / list_size), MAX_LISTS, max(1, len(fitted) // 4))
    index = spark.sparkContext.broadcast(fit(fitted, lists))
    posted = staged(_assign(distinct, index, COPIES, COPY_RATIO), "lists")
    # At most MAX_LISTS rows.
    held = np.zeros(lists, dtype=np.int64)
    for row in posted.groupBy("list").count().collect():
        held[row["list"]] = row["count"]
    parts = np.maximum(1, -(-held // PART))
    sizes = spark.sparkContext.broadcast((held, parts))

    asking = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asking = left_join_unique(
        asking.select(F.col("vec_id").alias("query_id"), "vector"),
        distinct.select("vector", F.col("rep").alias("query")),
        ["vector"],
    ).select("query_id", "query", "vector")
    asking = staged(asking, "queries")
    once = asking.groupBy(F.col("query").alias("rep")).agg(F.first("vector").alias("vector"))
    read = probes or max(PROBES, math.ceil(PROBES_BY_ROOT * math.sqrt(lists)))
    asked = _probe(once, index, sizes, read, PROBE_RATIO, 4 * COPIES * (k + 1))
    table = spark.createDataFrame(
        pd.DataFrame({"list": np.arange(lists, dtype=np.int32), "parts": parts.astype(np.int32)})
    )
    dealt = posted.join(F.broadcast(table), "list").select(
        "list", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep", "vector"
    )
    met = (
        asked.groupBy("list", "part")
        .cogroup(dealt.groupBy("list", "part"))
        .applyInPandas(_compare(k + 1), "query long, rep long, score double")
    )
    met = staged(met, "met").distinct()
    order = Window.partitionBy("query").orderBy("score", "rep")
    best = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    named = best.join(distinct.select("rep", "ids"), "rep").select(
        "query", F.explode("ids").alias("vec_id"), "score"
    )
    found = named.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found")
    )
    answers = left_join_unique(asking.select("query_id", "query"), found, ["query"])
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    return answers.select(
        "query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "one")
    ).select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("one")["vec_id"].alias("vec_id"),
        F.col("one")["score"].alias("score"),
    )
