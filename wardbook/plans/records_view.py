"""The record view: union, filter, deduplicate, format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.functions.display import nan_to_null
from wardbook.functions.timestamps import parse_timestamp, to_second, to_seconds_text
from wardbook.operators.dedup import keep_newest, newest_first, row_digest, union_widened
from wardbook.operators.filters import equal_if_given
from wardbook.plans.status_log import fold_status
from wardbook.sinks.table import DATE_COLUMN, DIGEST_COLUMN, with_event_date
from wardbook.sources.ledger import scan_uncommitted
from wardbook.sources.table import in_days, scan_audit_table

_HELPERS = ("__source", "__ts", DIGEST_COLUMN)


def records_view(
    landing: DataFrame,
    table: DataFrame | None = None,
    patient_id: str | None = None,
    status: str | None = None,
    keep_empty: bool = False,
    tie: list[str] | None = None,
    ordered: bool = False,
    resolution: str = "second",
    log: DataFrame | None = None,
) -> DataFrame:
    """Records without their copies.

    Copies share the transcript and the second of their timestamp; the newest
    stays, a landing document before a table row, then by ``tie`` (by default a
    hash of the row). The filters run before the deduplication and reach both scans.
    With the status ``log``, landing documents and table rows both get their
    current status before the status filter, so no record stands in two queues; without
    it the statuses are those that were stored. ``ordered`` sorts the result newest first, which costs a shuffle.
    ``resolution`` widens the time part of the key, to a day for example.
    """
    if not keep_empty:
        landing = landing.dropna(how="all")
    rows = landing.withColumn("__source", F.lit(0))
    if table is not None:
        rows = union_widened(rows, table.withColumn("__source", F.lit(1)))
    rows = equal_if_given(rows, "patient_id", patient_id)
    if log is not None:
        rows = fold_status(rows, log)
    rows = equal_if_given(rows, "status", status)
    rows = rows.withColumn("__ts", parse_timestamp(F.col("timestamp")))
    last: list[Column] = [F.col(c) for c in tie] if tie else [row_digest(rows, _HELPERS)]
    second = to_second(F.col("__ts")) if resolution == "second" else F.date_trunc(resolution, "__ts")
    kept = keep_newest(
        rows, [second, "raw_transcript"], F.col("__ts"), [F.col("__source"), *last]
    )
    if ordered:
        kept = newest_first(kept, F.col("__ts"), last)
    return nan_to_null(
        kept.withColumn("timestamp", to_seconds_text(F.col("__ts"))).drop(*_HELPERS)
    )


def register_audits(
    landing: DataFrame, table: DataFrame | None = None, log: DataFrame | None = None
) -> DataFrame:
    """C14: ``audits`` is the unfiltered record view under another name."""
    view = records_view(landing, table, log=log)
    view.createOrReplaceTempView("audits")
    return view


def current_records(
    spark: SparkSession,
    landing: str,
    table: str,
    layout: str = "lines",
    since: str | None = None,
    until: str | None = None,
    **choices,
) -> DataFrame:
    """The record view over an ingested landing folder and its table.

    Landing files whose documents the table holds already are not opened; a document stands
    for itself until its file is ingested. ``since`` and ``until`` (``YYYY-MM-DD``, both
    included) keep the records of those days and read their partitions only; copies share
    their day. ``choices`` are those of ``records_view``.
    """
    fresh = with_event_date(scan_uncommitted(spark, landing, table, layout=layout).dropna(how="all"))
    fresh = in_days(fresh, since, until)
    stored = scan_audit_table(spark, table, since=since, until=until, keep_digest=True)
    return records_view(fresh, stored, **choices).drop(DATE_COLUMN)
