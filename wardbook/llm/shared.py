"""Helpers of several operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.session import shared_folder

# Fixed value: the characters that part words.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor without
    computing ``df`` again.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_words(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quoted(names: list[str]) -> list[Column]:
    """Columns of these names, whatever characters are in them."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def numbered(df: DataFrame) -> DataFrame:
    """The frame with columns ``c0, c1, ...``: functions over batches take no odd names.

    ``toDF`` gives the names back.
    """
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def releasing(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives free memory back.

    Spark keeps idle workers, and what their allocators hold back counts against the executor.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        # Where the C library has no such call, nothing is done.
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return released


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it."""
    lower = {column.lower() for column in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
