"""All labelled rows of a table, and a logistic model fitted to them where they lie."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.llm.shared import releasing, staged

FOLDS = 5
#: Places in a bitmap for each labelled id; one place in so many is taken by chance.
PLACES = 8
_BITMAP = 8 * 4096
#: Rows added up at once, few enough for their sums to fit 64 bits.
_ROWS = 8192


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document may not be learned from; false for a null id."""
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0
    return F.coalesce(fold, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, text, label`` of every labelled document that may be learned from.

    Held-out documents, null ids and null labels take no part, nor do ids that are
    labelled both ways. Of rows with one id the smallest text counts. Most texts without
    label are left out before the shuffle.
    """
    learned = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    one = staged(
        labels.where(learned & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("most"))
        .where(F.col("label") == F.col("most"))
        .select("doc_id", F.col("label").cast("int").alias("label")),
        "labels",
    )
    texts = docs.where(learned).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Ids of another type hash differently.
    if docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType:
        texts = _perhaps_in(texts, one)
    found = texts.join(one, "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


#: The same by its former name; no sample is taken.
labelled_sample = labelled_rows


def _perhaps_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is in ``ids``, and about one in ``PLACES`` of the others.

    Ids are set in bitmaps by their hashes, a byte for each; Spark broadcasts those if small.
    """
    places = max(PLACES * ids.count(), _BITMAP)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(places))
    at, bit = F.floor(place / _BITMAP), place % _BITMAP
    # Written aside, so that their size is known before the texts are read.
    maps = staged(ids.groupBy(at.alias("__at")).agg(F.bitmap_construct_agg(bit).alias("__map")), "bitmaps")
    byte = F.conv(F.hex(F.substring("__map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mine = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    return rows.join(maps, at == F.col("__at")).where(mine).select(*rows.columns)


def exact_sums(rows: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray]) -> list[int]:
    """The whole numbers that ``sums`` gives for batches of rows, added up over all of them.

    They come out the same however rows are dealt and ordered. Empty for an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                total = total + sums(batch.slice(start, _ROWS)).astype(object)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.decimal128(38, 0))],
                names=["place", "total"],
            )

    parts = rows.mapInArrow(releasing(run), "place int, total decimal(38,0)")
    found = parts.groupBy("place").agg(F.sum("total").alias("total")).collect()
    return [int(r.total) for r in sorted(found)]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a batch's column of lists, each ``width`` long."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def units(rows: DataFrame, width: int) -> np.ndarray:
    """Powers of two by which ``features`` come to whole numbers below 2**16, one each."""
    most = rows.agg(*(F.max(F.abs(F.col("features")[i])) for i in range(width))).first()
    return np.array([2.0 ** (16 - math.frexp(m or 1.0)[1]) for m in most])


def moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each of ``features`` over all rows, of which there are some."""
    unit = units(rows, width)

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        whole = np.rint(matrix(batch.column("features"), width) * unit).astype(np.int64)
        return np.concatenate([[len(whole)], whole.sum(axis=0), (whole * whole).sum(axis=0)])

    n, *rest = exact_sums(rows.select("features"), sums)
    first, second = rest[:width], rest[width:]
    spread = [math.sqrt(n * b - a * a) / n for a, b in zip(first, second, strict=True)]
    return np.array([a / n for a in first]) / unit, np.array(spread) / unit


def logistic(rows: DataFrame, width: int, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of the mean logistic loss plus ``penalty`` times half their square, by Newton.

    ``rows`` has ``target`` (0 or 1) and ``features``, and is read once a round; the driver gets
    the sums of slopes and curvatures only. There is at least one row.
    """
    unit = units(rows, width)
    weights = np.zeros(width)
    for _ in range(rounds):
        pace = weights / unit

        def sums(batch: pa.RecordBatch, pace: np.ndarray = pace) -> np.ndarray:
            whole = np.rint(matrix(batch.column("features"), width) * unit)
            # Summed row by row, so that a row counts the same in any batch.
            chance = 1 / (1 + np.exp(-np.clip((whole * pace).sum(axis=1), -30, 30)))
            target = np.asarray(batch.column("target"), dtype=np.float64)
            miss = np.rint((chance - target) * 2**20).astype(np.int64)
            bend = np.rint(chance * (1 - chance) * 2**12).astype(np.int64)
            whole = whole.astype(np.int64)
            curve = (whole * bend[:, None]).T @ whole
            return np.concatenate([[len(whole)], whole.T @ miss, curve.ravel()])

        n, *rest = exact_sums(rows, sums)
        slope = np.array([s / n for s in rest[:width]]) / unit / 2**20 + penalty * weights
        curve = np.array([s / n for s in rest[width:]]).reshape(width, width) / 2**12
        curve = curve / unit / unit[:, None]
        step = np.linalg.solve(curve + penalty * np.eye(width), slope)
        weights = weights - step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return weights
