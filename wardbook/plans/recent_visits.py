"""W1 kept up to date: the last visits of every patient as a small table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook import schemas
from wardbook.operators.dedup import last_visits, row_digest
from wardbook.operators.history import history_of, visit_columns
from wardbook.operators.keyed import rows_with_keys
from wardbook.sinks.compaction import compact
from wardbook.sinks.table import BATCH_COLUMN


def _newest(rows: DataFrame) -> DataFrame:
    """The visits a patient's history can show; ties as in ``history_of``."""
    tie = row_digest(rows, ("patient_id", BATCH_COLUMN))
    return last_visits(rows, "patient_id", F.col("date"), [tie], fv.HISTORY_VISITS)


def merge_visits(records: DataFrame, store: str, batch: str) -> None:
    """Add the last visits among the records of one batch to the table at ``store``.

    A batch adds a few narrow rows per patient and rewrites nothing; a replayed batch replaces its
    own. ``compact_visits`` cuts the batches together.
    """
    rows = _newest(visit_columns(records.filter(F.col("patient_id").isNotNull())))
    named = rows.withColumn(BATCH_COLUMN, F.lit(batch)).sortWithinPartitions("patient_id")
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BATCH_COLUMN).parquet(store)


def visits_in(spark: SparkSession, store: str) -> DataFrame:
    """The kept visits, up to a few per patient and batch."""
    return spark.read.schema(schemas.VISIT).parquet(store).select(*schemas.VISIT.names)


def kept_history(
    spark: SparkSession, store: str, patients: DataFrame | None = None, indented: bool = True
) -> DataFrame:
    """``patient_history`` from the kept visits; no record is read."""
    rows = visits_in(spark, store)
    if patients is not None:
        rows = rows_with_keys(rows, patients, ["patient_id"])
    return history_of(rows, indented=indented)


def compact_visits(spark: SparkSession, store: str) -> None:
    """Bring the batches of the table together and keep a patient's last visits only."""
    compact(spark, store, [BATCH_COLUMN], rewrite=_newest)
