"""Scans of the audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardbook import schemas
from wardbook.sinks.table import BATCH_COLUMN, DATE_COLUMN, DIGEST_COLUMN


def scan_audit_table(
    spark: SparkSession,
    path: str,
    schema: StructType = schemas.AUDIT_RECORD,
    table_format: str = "parquet",
    skip_corrupt: bool = False,
    keep_batch: bool = False,
    keep_digest: bool = False,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """The audit table under its newest schema.

    Files written before a column existed give null for it. The schema is given
    rather than merged, so no footer is read up front. ``skip_corrupt`` passes
    over damaged files; leave it off where losing rows must not go unnoticed. ``since``
    and ``until`` (``YYYY-MM-DD``, both included) read the partitions of those days only;
    undated records lie under the first day of 1970. ``keep_batch`` and ``keep_digest`` add the
    name of a row's batch and the stored digest of its transcript, null in older files.
    """
    if table_format == "delta":
        reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
        rows = in_days(reader.format("delta").load(path), since, until)
    else:
        wide = StructType([*schema.fields, schemas.AUDIT_DIGEST])
        rows = scan_partitions(spark, path, wide, since, until, skip_corrupt)
    hidden = [c for c, kept in ((BATCH_COLUMN, keep_batch), (DIGEST_COLUMN, keep_digest)) if not kept]
    return rows.drop(*hidden)


def in_days(rows: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Rows of a range of event dates, both included."""
    if since is not None:
        rows = rows.filter(F.col(DATE_COLUMN) >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col(DATE_COLUMN) <= F.lit(until).cast("date"))
    return rows


def scan_partitions(
    spark: SparkSession,
    path: str,
    schema: StructType,
    since: str | None = None,
    until: str | None = None,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Rows of a table that ``write_batch`` keeps, with its partition columns."""
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    wide = StructType([*schema.fields, schemas.AUDIT_PARTITION])
    return in_days(reader.schema(wide).parquet(path), since, until)


def scan_any_columns(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """S4, opt-in: union of the columns of all files, read from every footer."""
    options = {"mergeSchema": "true", "ignoreCorruptFiles": str(skip_corrupt).lower()}
    return spark.read.options(**options).parquet(path)
