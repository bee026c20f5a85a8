"""Whitening of embeddings by the components of their exact covariance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.feast import largest
from wardbook.llm.shared import staged

#: Components that are kept.
COMPONENTS = 16
# A component c is counted as floor(64 c) + 1,000,000.
SCALE = 64
OFFSET = 1_000_000
#: Scaled components beyond this count as this much, so that all sums stay exact.
LIMIT = 2**40
#: Whole numbers below this are exact as doubles.
_EXACT = 2**53
_LONG = 2**63


@dataclass(frozen=True)
class Fit:
    """Mean and components of the distinct vectors of one length."""

    n: int
    total: list[int]
    centre: np.ndarray
    shift: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    axes: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of long rows along the components, each over its deviation."""
        return ((x - self.centre) - self.shift) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n x - S)^2`` of each row, exactly; null where no long holds it."""
        own = x - self.centre
        rest = [s - self.n * int(c) for s, c in zip(self.total, self.centre, strict=True)]
        rough = ((own.astype(np.float64) * self.n - np.array(rest, dtype=np.float64)) ** 2).sum(axis=1)
        found: list[int | None] = []
        small = rough < _LONG / 4
        if small.all():
            return ((own * self.n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        for row in own.tolist():
            exact = sum((self.n * a - b) ** 2 for a, b in zip(row, rest, strict=True))
            found.append(exact if exact < _LONG else None)
        return found


def counted_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: rows whose vector is not null and has finite components only."""
    numbers = F.col("embedding").cast("array<double>")
    finite = F.forall(
        numbers, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    limit = F.lit(float(LIMIT))

    def number(c):
        return F.floor(F.greatest(F.least(c * SCALE, limit), -limit)).cast("long") + OFFSET

    kept = vectors.where(numbers.isNotNull()).where(finite)
    return kept.select("vec_id", F.transform(numbers, number).alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors ``x`` of a batch, one length above zero at a time."""
    column = batch.column("x")
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes[sizes > 0]):
        places = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        yield places, flat.reshape(len(places), int(size))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of a task, per length and dimension."""
    totals: dict[int, list[int]] = {}
    counts: dict[int, int] = defaultdict(int)
    for batch in batches:
        for _, x in _matrices(batch):
            size = x.shape[1]
            counts[size] += len(x)
            before = totals.setdefault(size, [0] * size)
            totals[size] = [a + b for a, b in zip(before, x.sum(axis=0).tolist(), strict=True)]
    rows = [(s, i, counts[s], Decimal(v)) for s, t in totals.items() for i, v in enumerate(t)]
    yield _batch(rows, _SUMS)


_SUMS = pa.schema(
    [("size", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]
)
_PRODUCTS = pa.schema(
    [("size", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def exact_products(x: np.ndarray) -> list[list[int]]:
    """``x.T @ x`` of whole numbers, without rounding.

    Blocks are short enough for all sums to be exact as doubles; only numbers too large for
    that are multiplied as Python numbers.
    """
    most = int(np.abs(x).max(initial=0))
    if most * most >= _EXACT:
        wide = x.astype(object)
        return (wide.T @ wide).tolist()
    block = max(1, min(len(x), _EXACT // max(1, most * most)))
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for at in range(0, len(x), block):
        part = x[at : at + block].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total.tolist()


def _products(centres: dict[int, np.ndarray]) -> Callable:
    """Products of the centred components, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                size = x.shape[1]
                found = np.array(exact_products(x - centres[size]), dtype=object)
                found = found.reshape(size, size)
                totals[size] = totals[size] + found if size in totals else found
        rows = [
            (s, i, j, Decimal(int(t[i, j]))) for s, t in totals.items() for i in range(s) for j in range(i, s)
        ]
        yield _batch(rows, _PRODUCTS)

    return run


def fits(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit per length of the distinct vectors ``x``.

    Two passes: sums, then products of the components less their mean as a whole number.
    What that leaves out of the centring is taken off in whole numbers too, so the
    covariance is exact until its last division. Tasks sum up their own rows; the driver gets
    one number per pair of dimensions.
    """
    sums = distinct.mapInArrow(_sums, "size int, dim int, n long, total decimal(38,0)")
    found: dict[int, list] = defaultdict(list)
    for r in sums.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("s")).collect():
        found[r["size"]].append((r["dim"], r["n"], int(r["s"])))
    counts = {size: rows[0][1] for size, rows in found.items()}
    totals = {size: [s for _, _, s in sorted(rows)] for size, rows in found.items()}
    centres = {
        size: np.array([(2 * s + counts[size]) // (2 * counts[size]) for s in t], dtype=np.int64)
        for size, t in totals.items()
    }
    products = distinct.mapInArrow(_products(centres), "size int, i int, j int, total decimal(38,0)")
    matrices = {size: np.zeros((size, size)) for size in totals}
    rest = {
        size: [s - counts[size] * int(c) for s, c in zip(t, centres[size], strict=True)]
        for size, t in totals.items()
    }
    for r in products.groupBy("size", "i", "j").agg(F.sum("total").alias("g")).collect():
        size, i, j = r["size"], r["i"], r["j"]
        n = counts[size]
        exact = n * int(r["g"]) - rest[size][i] * rest[size][j]
        matrices[size][i, j] = matrices[size][j, i] = exact / (n * n)
    result = {}
    for size, matrix in matrices.items():
        values, vectors = largest(matrix, components)
        n = counts[size]
        result[size] = Fit(
            n,
            totals[size],
            centres[size],
            np.array([r / n for r in rest[size]]),
            values,
            values / np.trace(matrix) if len(values) else values,
            vectors / np.sqrt(values),
        )
    return result


def _moments(models: dict[int, Fit]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, np.ndarray] = {}
        second: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                size = x.shape[1]
                if size not in models:
                    continue
                w = models[size].whitened(x)
                first[size] = first.get(size, 0) + w.sum(axis=0)
                second[size] = second.get(size, 0) + w.T @ w
        rows = [
            (s, i, j, float(t[i, j])) for s, t in second.items() for i in range(len(t)) for j in range(i, len(t))
        ]
        rows += [(s, i, -1, float(v)) for s, t in first.items() for i, v in enumerate(t)]
        yield _batch(rows, pa.schema([*list(_PRODUCTS)[:3], ("total", pa.float64())]))

    return run


def identity_error(distinct: DataFrame, models: dict[int, Fit]) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, in size.

    Measured on the vectors, over all lengths; zero without components.
    """
    sums = distinct.mapInArrow(_moments(models), "size int, i int, j int, total double")
    rows = sums.groupBy("size", "i", "j").agg(F.sum("total").alias("t")).collect()
    means = {(r["size"], r["i"]): r["t"] / models[r["size"]].n for r in rows if r["j"] < 0}
    worst = 0.0
    for r in rows:
        size, i, j = r["size"], r["i"], r["j"]
        if j >= 0:
            entry = r["t"] / models[size].n - means[size, i] * means[size, j]
            worst = max(worst, abs(entry - (i == j)))
    return worst


def _projected(models: dict[int, Fit], error: float) -> Callable:
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _matrices(batch):
                model = models.get(x.shape[1])
                width = len(model.values) if model else 0
                if not width:
                    continue
                count = len(places) * width
                repeated = np.repeat(places, width)
                far = pa.array(model.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(repeated)),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(places))),
                        pa.array(np.full(count, model.n, dtype=np.int64)),
                        far.take(pa.array(np.repeat(np.arange(len(places)), width))),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.explained, len(places))),
                        pa.array(np.full(count, error)),
                    ],
                    names=names,
                )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    A row per usable vector and component, of the ``components`` with the largest
    eigenvalues. Rows whose vector is null or has null or non-finite components are left out;
    other columns, whatever their names, are not read. The fit sees each distinct vector
    once, however many rows have it; every row, repeated ones too, gets its coordinates.

    Vectors of another length lie in another space: each length has a fit of its own, with
    its own ``n``. A component without variance is no component, so a single vector, equal
    vectors and an empty table give no rows. Components beyond 2^40 / 64 count as that.
    ``deviation`` is null where a long cannot hold it.
    """
    counted = counted_vectors(vectors)
    distinct = staged(counted.select("x").distinct(), "distinct-vectors")
    models = fits(distinct, components)
    error = identity_error(distinct, models)
    ddl = (
        f"vec_id {counted.schema[0].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    return counted.mapInArrow(_projected(models, error), ddl)
