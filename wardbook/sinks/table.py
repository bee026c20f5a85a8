"""Writes to the audit table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardbook import fixed_values as fv
from wardbook import schemas
from wardbook.functions.timestamps import parse_timestamp
from wardbook.session import drop_folder, shared_folder

DATE_COLUMN = "event_date"
BATCH_COLUMN = "ingest_batch"
PARTITION_COLUMNS = [DATE_COLUMN, BATCH_COLUMN]
DIGEST_COLUMN = "transcript_digest"
PLAIN_APPEND = "append"
UNDATED = "1970-01-01"


def with_audit_columns(df: DataFrame) -> DataFrame:
    """The two typed constants of every committed record."""
    return df.withColumns(
        {
            "is_leak": F.lit(fv.AUDIT_IS_LEAK).cast("boolean"),
            "risk_score": F.lit(fv.AUDIT_RISK_SCORE).cast("double"),
        }
    )


def audit_projection(df: DataFrame) -> DataFrame:
    """The columns the batch job reports."""
    return df.select("timestamp", "patient_id", "status")


def with_event_date(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """The partition column, from the payload's own time; 1970-01-01 if unreadable."""
    day = F.to_date(parse_timestamp(F.col(time)))
    return df.withColumn(DATE_COLUMN, F.coalesce(day, F.lit(UNDATED).cast("date")))


def in_table_form(df: DataFrame, schema: StructType = schemas.AUDIT_RECORD) -> DataFrame:
    """Exactly the table's columns in the table's order; missing ones are null."""
    have = set(df.columns)
    columns = [
        F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*columns)


def with_digest(rows: DataFrame) -> DataFrame:
    """The key by which updates find transcripts, made once when a row is stored."""
    return rows.withColumn(DIGEST_COLUMN, F.sha2("raw_transcript", 256))


def clustered(rows: DataFrame, partition_by: list[str]) -> DataFrame:
    """Each file's rows by patient, so that a patient's lookup skips most row groups.

    The partition columns come first, as the writer wants them sorted anyway.
    """
    keys = [c for c in ("patient_id",) if c in rows.columns]
    return rows.sortWithinPartitions(*partition_by, *keys)


def append_to_table(
    df: DataFrame,
    path: str,
    schema: StructType = schemas.AUDIT_RECORD,
    table_format: str = "parquet",
) -> None:
    """K1: append, partitioned by event date.

    ``rebalance`` sizes the files from the measured shuffle: small days share a
    task, and a day that holds most of the rows is split over many.
    """
    rows = with_event_date(in_table_form(df, schema)).withColumn(
        BATCH_COLUMN, F.lit(PLAIN_APPEND)
    )
    if schema is not schemas.AUDIT_RECORD_V0:
        rows = with_digest(rows)
    rows = rows.hint("rebalance", DATE_COLUMN)
    writer = clustered(rows, PARTITION_COLUMNS).write.mode("append").format(table_format)
    writer = writer.partitionBy(*PARTITION_COLUMNS)
    if table_format == "delta":
        writer = writer.option("mergeSchema", "true")
    writer.save(path)


def write_batch(
    df: DataFrame,
    path: str,
    batch: str,
    schema: StructType,
    bloom: Sequence[str] = (),
    period: str = "day",
) -> None:
    """Write one numbered batch so that writing it again changes nothing.

    The batch name is a partition below the date; a replay replaces exactly the
    partitions its first run wrote. Status events lie under the day they happened, not that
    of the record they name. A ``period`` of a month lays its days together under the first
    one, for tables that are looked up by other things than days. Columns in ``bloom`` get a filter by which a lookup passes over
    row groups.
    """
    time = next(c for c in ("event_time", "timestamp", "date") if c in schema.names)
    rows = with_event_date(in_table_form(df, schema), time).withColumn(BATCH_COLUMN, F.lit(batch))
    if "raw_transcript" in schema.names:
        rows = with_digest(rows)
    if period != "day":
        rows = rows.withColumn(DATE_COLUMN, F.trunc(DATE_COLUMN, period))
    overwrite_partitions(rows.hint("rebalance", DATE_COLUMN), path, PARTITION_COLUMNS, bloom)


def overwrite_partitions(
    rows: DataFrame, path: str, partition_by: list[str], bloom: Sequence[str] = ()
) -> None:
    """Write rows in place of the partitions they lie in."""
    writer = clustered(rows, partition_by).write.mode("overwrite")
    # Sized by what a file holds.
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def replace_partitions(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    partition_by: list[str] = PARTITION_COLUMNS,
) -> None:
    """Replace the partitions that ``rows`` covers and leave all others alone.

    ``rows`` usually reads ``path`` itself, so it is first written aside to the
    shared folder and read back from there. One writer at a time. The copy is removed
    after the replacement; if that fails, it stays and holds what is missing.
    """
    aside = shared_folder(spark, "rewrite")
    rows.write.partitionBy(*partition_by).parquet(aside)
    staged = spark.read.schema(rows.schema).parquet(aside)
    overwrite_partitions(staged.hint("rebalance", *partition_by), path, partition_by)
    drop_folder(spark, aside)
