"""Status events into the log, and on demand into the table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardbook import schemas
from wardbook.plans.status_log import fold_into_table, touched_days
from wardbook.sinks.table import BATCH_COLUMN, DATE_COLUMN, UNDATED, write_batch
from wardbook.streaming.batches import UNTIL_CAUGHT_UP, start_batches
from wardbook.streaming.ingest import FILES_PER_BATCH, batch_documents, document_stream


def status_log(spark: SparkSession, log: str, since: date | None = None) -> DataFrame:
    """The logged status events with the digests of their transcripts; with ``since``, those
    that happened on that day or later."""
    wide = StructType([*schemas.STATUS_EVENT.fields, schemas.AUDIT_DIGEST, schemas.AUDIT_PARTITION])
    rows = spark.read.schema(wide).parquet(log)
    if since is not None:
        rows = rows.filter(F.col(DATE_COLUMN) >= F.lit(since))
    return rows.drop(DATE_COLUMN, BATCH_COLUMN)


def log_status_events(
    spark: SparkSession,
    events: str,
    log: str,
    checkpoint: str,
    table: str | None = None,
    layout: str = "auto",
    files_per_batch: int = FILES_PER_BATCH,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append every status event to the log once.

    Readers fold the log over the records (``plans.status_log``). With ``table``,
    the log is also folded into the partitions of the table that a batch changes;
    that suits few large batches, not many small ones. Only the days that an event of the
    batch may reach are read. On them all of the log since the first of these days is folded,
    so an old event that comes late does not override a newer one, and none can reach a
    record younger than itself.
    """
    schema = schemas.STATUS_EVENT
    stream = document_stream(spark, events, schema, files_per_batch)

    def write(batch: DataFrame, name: str) -> None:
        lines = batch.persist()
        rows = batch_documents(spark, lines, schema, layout).select(*schema.names)
        write_batch(rows, log, name, schema)
        if table is not None:
            days = touched_days(spark, table, rows)
            first = min(days, default=None)
            since = None if first == date.fromisoformat(UNDATED) else first
            fold_into_table(spark, table, status_log(spark, log, since), days)
        lines.unpersist()

    return start_batches(stream, checkpoint, write, trigger or UNTIL_CAUGHT_UP)
