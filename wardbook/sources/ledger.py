"""Which landing files the audit table holds already, and what lies in the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardbook import schemas
from wardbook.sources.documents import DOCUMENT_FILES, FILE, as_paths, scan_documents

FILES_DDL = "file_path string, documents long, committed long"


def ledger_of(table: str) -> str:
    """Where ingest lists the files of a table."""
    return f"{table.rstrip('/')}-files"


def write_files(rows: DataFrame, table: str, batch: str, needed: str) -> None:
    """List the files of a batch: documents that can be read, and those with what they need.

    ``rows`` has ``FILE``, ``damaged`` and the ``needed`` column. Only the counts travel; a
    replayed batch replaces its list.
    """
    readable = ~F.col("damaged")
    counts = rows.groupBy(F.col(FILE).alias("file_path")).agg(
        F.count_if(readable).alias("documents"),
        F.count_if(readable & F.col(needed).isNotNull()).alias("committed"),
    )
    writer = counts.withColumn("ingest_batch", F.lit(batch)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch").parquet(
        ledger_of(table)
    )


def settled_files(spark: SparkSession, table: str) -> DataFrame:
    """``file_path`` of the files whose readable documents are all in the table.

    A file with a document that was not committed, one without transcript, say, is not
    settled: its documents are in the landing folder only.
    """
    ledger = ledger_of(table)
    spark.createDataFrame([], FILES_DDL).write.mode("ignore").parquet(f"{ledger}/ingest_batch=none")
    listed = spark.read.schema(FILES_DDL).parquet(ledger)
    return listed.where("documents = committed").select("file_path").distinct()


def listing(spark: SparkSession, path: str, files: str = DOCUMENT_FILES) -> DataFrame:
    """``file_path, length`` of the files of a folder; no content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", files)
    return reader.load(path).select("_metadata.file_path", "length")


def uncommitted_files(
    spark: SparkSession, landing: str, table: str, files: str = DOCUMENT_FILES
) -> list[str]:
    """Files of the landing folder that the view has to read, the table aside.

    The names come to the driver, which would list all of the folder to read it.
    """
    listed = listing(spark, landing, files).where(F.col("length") > 0)
    rest = listed.join(settled_files(spark, table), "file_path", "left_anti")
    return sorted(r["file_path"] for r in rest.collect())


def scan_uncommitted(
    spark: SparkSession,
    landing: str,
    table: str,
    schema: StructType = schemas.CLINICAL_RECORD,
    layout: str = "lines",
    files: str = DOCUMENT_FILES,
) -> DataFrame:
    """The landing documents that the table does not hold; settled files are not opened."""
    names = uncommitted_files(spark, landing, table, files)
    if not names:
        return spark.createDataFrame([], schema)
    return scan_documents(spark, as_paths(names), schema, layout, files)
