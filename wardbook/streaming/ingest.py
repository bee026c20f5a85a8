"""Landing folder into the audit table, each document once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardbook import schemas
from wardbook.plans.commit import records_to_commit
from wardbook.plans.recent_visits import merge_visits
from wardbook.sinks.table import write_batch
from wardbook.sources.documents import (
    CORRUPT,
    DOCUMENT_FILES,
    FILE,
    checked_layout,
    is_damaged,
    reader_options,
    routed,
    whole_documents,
    with_corrupt,
)
from wardbook.sources.ledger import write_files
from wardbook.streaming.batches import UNTIL_CAUGHT_UP, start_batches

FILES_PER_BATCH = 10_000
# By default a file much older than the newest one seen would never be read.
ANY_AGE = "36500d"


def document_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    files_per_batch: int = FILES_PER_BATCH,
    archive: str | None = None,
    files: str = DOCUMENT_FILES,
) -> DataFrame:
    """The lines of a folder's files as a stream of documents with their ``FILE``.

    Sub-folders are left out, and files are read however old they are. With ``archive``,
    files go there once their batch is done, which keeps the folder and the list of files
    already seen short.
    """
    reader = spark.readStream.schema(with_corrupt(schema)).options(**reader_options(False, files))
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if archive is not None:
        reader = reader.options(cleanSource="archive", sourceArchiveDir=archive)
    rows = reader.options(maxFilesPerTrigger=files_per_batch, maxFileAge=ANY_AGE).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias(FILE))


def batch_documents(
    spark: SparkSession, lines: DataFrame, schema: StructType, layout: str, files: str = DOCUMENT_FILES
) -> DataFrame:
    """A batch of lines, but of files that are one JSON value the documents they are."""
    if not checked_layout(layout):
        return lines
    return routed(spark, lines, whole_documents(spark, lines.where(is_damaged())), schema, files)


def quarantine_of(table: str) -> str:
    """Where ingest keeps the damaged documents of a table."""
    return f"{table.rstrip('/')}-quarantine"


def ingest_folder(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    layout: str = "auto",
    files_per_batch: int = FILES_PER_BATCH,
    trigger: dict | None = None,
    quarantine: str | None = None,
    archive: str | None = None,
    files: str = DOCUMENT_FILES,
    visits: str | None = None,
) -> StreamingQuery:
    """Take the documents that have arrived since the last run, then stop.

    Running it again adds nothing, and neither does the replay of a batch that
    was cut short: its partitions are replaced by the same rows. Documents that are no JSON
    go to ``quarantine`` in the same batch, by default beside the table, with their file.
    The files of the batch go to the table's ledger (``sources.ledger``). With ``visits``,
    the last visits per patient kept there are brought up to date.
    """
    schema = schemas.CLINICAL_RECORD

    def commit(good: DataFrame, name: str) -> None:
        rows = records_to_commit(good)
        write_batch(rows, table, name, schemas.AUDIT_RECORD)
        if visits is not None:
            merge_visits(rows, visits, name)

    return ingest_documents(
        spark, landing, table, checkpoint, schema, "raw_transcript", commit, layout,
        files_per_batch, trigger, quarantine, archive, files,
    )


def ingest_documents(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    schema: StructType,
    needed: str,
    commit: Callable[[DataFrame, str], None],
    layout: str = "auto",
    files_per_batch: int = FILES_PER_BATCH,
    trigger: dict | None = None,
    quarantine: str | None = None,
    archive: str | None = None,
    files: str = DOCUMENT_FILES,
) -> StreamingQuery:
    """``commit(documents, batch_name)`` for the new documents of a folder that have ``needed``.

    A batch is parsed once, and held while its parts are counted and written. An executor
    lost meanwhile costs the parsing of its part.
    """
    checked_layout(layout)
    bad_rows = quarantine or quarantine_of(table)
    lines = document_stream(spark, landing, schema, files_per_batch, archive, files)

    def write(batch: DataFrame, name: str) -> Mapping[str, int]:
        lines = batch.persist()
        parsed = batch_documents(spark, lines, schema, layout, files)
        rows = parsed.withColumn("damaged", F.coalesce(is_damaged(), F.lit(False)))
        held = rows if parsed is lines else rows.persist()
        try:
            good = held.where("NOT damaged").where(F.col(needed).isNotNull())
            bad = held.where("damaged").select(F.col(FILE).alias("file_path"), F.col(CORRUPT).alias("document"))
            has = ~F.col("damaged") & F.col(needed).isNotNull()
            counts = held.agg(F.count_if(has), F.count_if("damaged")).first()
            if counts[1]:
                _set_aside(bad, bad_rows, name)
            if counts[0]:
                commit(good.drop(FILE, CORRUPT, "damaged"), name)
            # Last, so that a file in the ledger is in the table too.
            write_files(held, table, name, needed)
        finally:
            held.unpersist()
            lines.unpersist()
        return {"committed": counts[0], "quarantined": counts[1]}

    return start_batches(lines, checkpoint, write, trigger or UNTIL_CAUGHT_UP)


def _set_aside(bad: DataFrame, path: str, batch: str) -> None:
    """Write a batch's damaged documents under its name."""
    writer = bad.withColumn("ingest_batch", F.lit(batch)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("ingest_batch").parquet(path)


def committed_rows(query: StreamingQuery) -> int:
    """A1: rows that this run has written."""
    return query.totals["committed"]


def quarantined_rows(query: StreamingQuery) -> int:
    """A1: damaged documents that this run has set aside."""
    return query.totals["quarantined"]
