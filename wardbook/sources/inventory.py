"""What lies in the folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardbook.operators.keyed import left_join_unique
from wardbook.session import Folder
from wardbook.sources.documents import DOCUMENT_FILES, FILE, is_damaged, with_file
from wardbook.sources.ledger import listing


def _file_name(path: Column) -> Column:
    """The last step of a path as it is, decoded; a plus sign stands for itself there."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name")


def folder_files(
    spark: SparkSession,
    area: str,
    path: str,
    schema: StructType,
    layout: str = "auto",
    files: str = DOCUMENT_FILES,
) -> DataFrame:
    """``area, file_name, length, records, damaged`` of every file of a document folder.

    Files come from the listing, so one that is empty or holds nothing but damaged documents
    is there too, with no records.
    """
    counts = (
        with_file(spark, path, schema, layout, files)
        .groupBy(F.col(FILE).alias("file_path"))
        .agg(F.count_if(~is_damaged()).alias("records"), F.count_if(is_damaged()).alias("damaged"))
    )
    found = _named(area, listing(spark, path, files), counts)
    endings = files.removeprefix("*").strip("{}").split(",")
    empty = [name for ending in endings for name in Folder(spark, path).empty_files(ending)]
    if not empty:
        return found
    none = spark.createDataFrame([(area, name, 0, 0, 0) for name in empty], found.schema)
    return found.unionByName(none)


def table_files(spark: SparkSession, area: str, path: str) -> DataFrame:
    """The same of the files of a table; their rows are counted from the footers."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file_path"))
    counts = rows.groupBy("file_path").agg(
        F.count("*").alias("records"), F.lit(0).cast("long").alias("damaged")
    )
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    listed = reader.load(path).select("_metadata.file_path", "length")
    return _named(area, listed, counts)


def _named(area: str, listed: DataFrame, counts: DataFrame) -> DataFrame:
    joined = left_join_unique(listed, counts, ["file_path"]).fillna(0, ["records", "damaged"])
    name = _file_name(F.col("file_path"))
    return joined.select(F.lit(area).alias("area"), name, "length", "records", "damaged")


def inventory(files: list[DataFrame]) -> DataFrame:
    """The files of several areas in one frame."""
    return reduce(DataFrame.unionByName, files)


def area_totals(files: DataFrame) -> DataFrame:
    """Files, records and damaged documents per area."""
    return files.groupBy("area").agg(
        F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("damaged").alias("damaged")
    )
