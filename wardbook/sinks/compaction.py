"""Bringing the small files of many batches together."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardbook.session import Folder
from wardbook.sinks.table import PARTITION_COLUMNS

#: Folders of fewer bytes are brought together.
SMALL = 64 * 2**20
# Readers pass over names that start so.
_ASIDE = "_compaction"
_PLAN = "plan"
_DATA = "data"


def folder_sizes(spark: SparkSession, table: str, partition_by: list[str]) -> DataFrame:
    """``folder, group, batch, length, number`` of every partition folder, by its names alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.option("pathGlobFilter", "*.parquet").load(table)
    path = F.col("_metadata.file_path")
    steps = F.slice(F.split(path, "/"), -len(partition_by) - 1, len(partition_by))
    batch = F.regexp_extract(F.element_at(steps, -1), r"=(.*)$", 1)
    named = files.where(F.array_join(steps, "/").contains("=")).where(~path.contains(f"/{_ASIDE}/"))
    return named.groupBy(
        F.array_join(steps, "/").alias("folder"),
        F.array_join(F.slice(steps, 1, len(partition_by) - 1), "/").alias("group"),
        batch.alias("batch"),
    ).agg(F.sum("length").alias("length"), F.count("*").alias("number"))


def folders_to_compact(
    spark: SparkSession, table: str, partition_by: list[str], small: int = SMALL
) -> DataFrame:
    """``folder, group`` of small folders of which a day has more than one.

    The newest batch of each stream stays out: it is the one that may be written again.
    """
    found = folder_sizes(spark, table, partition_by)
    numbered = found.withColumns(
        {
            "stream": F.regexp_extract("batch", r"^(.*)-\d+$", 1),
            "at": F.regexp_extract("batch", r"-(\d+)$", 1),
        }
    )
    newest = numbered.where("stream != ''").groupBy("stream").agg(F.max("at").alias("newest"))
    kept = numbered.join(newest, "stream", "left").where("newest IS NULL OR at < newest")
    little = kept.where(F.col("length") < small)
    several = little.groupBy("group").agg(F.count("*").alias("folders")).where("folders > 1")
    return little.join(several, "group", "left_semi").select("folder", "group")


def compact(
    spark: SparkSession,
    table: str,
    partition_by: list[str] = PARTITION_COLUMNS,
    small: int = SMALL,
    rewrite: Callable[[DataFrame], DataFrame] | None = None,
    schema: StructType | None = None,
) -> int:
    """K1: rewrite the small folders of each day as one batch; how many folders that were.

    The last partition column names the batch. The rows are written aside first, then the
    list of folders they come from; only when both are whole are the new folders moved in
    and the old ones removed. A run that is cut short before that leaves the table as it was,
    one that is cut short later is finished by the next: until then the rows of a day may
    stand twice, which the record view does not show. One writer at a time; readers that run
    meanwhile may miss removed files. Only names pass through the driver.
    """
    finish(spark, table)
    name = f"compact{uuid.uuid4().hex}"
    aside = posixpath.join(table, _ASIDE, name)
    chosen = sorted(r["folder"] for r in folders_to_compact(spark, table, partition_by, small).collect())
    if not chosen:
        return 0
    batch = partition_by[-1]
    paths = [posixpath.join(table, folder) for folder in chosen]
    reader = spark.read.option("basePath", table)
    # Columns that only some files have are null in the others.
    reader = reader.schema(schema) if schema else reader.option("mergeSchema", "true")
    rows = reader.parquet(*paths)
    if rewrite is not None:
        rows = rewrite(rows)
    rows = rows.withColumn(batch, F.lit(name))
    days = partition_by[:-1]
    rows = rows.hint("rebalance", *days) if days else rows.hint("rebalance")
    keys = [c for c in ("patient_id",) if c in rows.columns]
    rows = rows.sortWithinPartitions(*days, *keys) if days or keys else rows
    rows.write.partitionBy(*partition_by).parquet(posixpath.join(aside, _DATA))
    plan = spark.createDataFrame([(folder,) for folder in chosen], "folder string")
    plan.write.parquet(posixpath.join(aside, _PLAN))
    _swap(spark, table, aside)
    return len(chosen)


def finish(spark: SparkSession, table: str) -> None:
    """Finish or clear away what a run of ``compact`` left when it was cut short."""
    for aside in Folder(spark, posixpath.join(table, _ASIDE)).children():
        if Folder(spark, posixpath.join(aside, _PLAN, "_SUCCESS")).exists():
            _swap(spark, table, aside)
        else:
            Folder(spark, aside).delete()


def _swap(spark: SparkSession, table: str, aside: str) -> None:
    """Move the new folders in, then remove the old ones; doing it again changes nothing."""
    data = posixpath.join(aside, _DATA)
    for step in Folder(spark, data).partitions():
        Folder(spark, posixpath.join(data, step)).move_to(posixpath.join(table, step))
    old = spark.read.parquet(posixpath.join(aside, _PLAN)).collect()
    for row in old:
        Folder(spark, posixpath.join(table, row["folder"])).delete()
    Folder(spark, aside).delete()
