"""Status events as an append-only log, folded over the records when read.

One status change then costs one small append; the records themselves are
rewritten only by ``fold_into_table``, in the partitions that changed.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.timestamps import first_token, parse_timestamp
from wardbook.operators.keyed import (
    match_dispenses,
    match_updates,
    rows_with_keys,
    transcript_key,
)
from wardbook.session import drop_folder, shared_folder
from wardbook.sinks.table import DATE_COLUMN, PARTITION_COLUMNS, UNDATED, overwrite_partitions
from wardbook.sources.table import scan_audit_table


def fold_status(records: DataFrame, log: DataFrame) -> DataFrame:
    """J2 and J3 together: the latest event that matches a record sets its status.

    An event with a transcript names one record and carries its new status; one
    without dispenses all that its patient had. Neither reaches a record younger
    than its ``event_time``, which also orders them; at the same instant a dispense
    wins, then the greater status text. An event without a readable time does nothing.
    """
    named = F.col("raw_transcript").isNotNull()
    rows = match_dispenses(records, log.filter(~named), "event_time")
    updates = log.filter(named).withColumn("__at", parse_timestamp(F.col("event_time")))
    rows = match_updates(rows, updates, ["__at", "status"], event_time="__at")
    updated = F.col("__order").isNotNull()
    served = F.col("__served")
    served_last = served & (~updated | (F.col("__served_at") >= F.col("__order")["__at"]))
    status = (
        F.when(F.coalesce(served_last, F.lit(False)), fv.STATUS_DISPENSED)
        .when(updated, F.col("__status"))
        .otherwise(F.col("status"))
    )
    pharmacy = F.when(served, fv.STATUS_DISPENSED).otherwise(F.col("pharmacy_status"))
    return rows.withColumns({"status": status, "pharmacy_status": pharmacy}).select(
        *records.columns
    )


def pending_queue(records: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Records that still wait for the pharmacy."""
    current = records if log is None else fold_status(records, log)
    return current.filter(F.col("status") == fv.STATUS_PENDING_PHARMACY)


def touched_days(spark: SparkSession, table: str, events: DataFrame) -> list[date]:
    """The days on which the table has records that one of the events may reach.

    Only keys and days are read, no records: patients for dispenses, stored digests for
    updates. Where no event but updates with a date has come, the days around those dates
    are all that is looked at. The days themselves, a few thousand at most, go to the driver.
    """
    updates = events.filter(F.col("raw_transcript").isNotNull())
    dispenses = events.filter(F.col("raw_transcript").isNull() & F.col("patient_id").isNotNull())
    keys = scan_audit_table(spark, table, keep_digest=True)
    start = F.regexp_extract(first_token(F.col("timestamp")), r"^\d{4}-\d{2}-\d{2}", 0)
    named = updates.select(parse_timestamp(start).cast("date").alias("day"))
    if dispenses.isEmpty() and not (near := _around(named)) is None:
        keys = keys.filter(F.col(DATE_COLUMN).isin(near))
    of_patients = rows_with_keys(
        keys.select(DATE_COLUMN, "patient_id"), dispenses.select("patient_id"), ["patient_id"]
    )
    digests = updates.select(transcript_key(updates).alias("key"))
    of_texts = rows_with_keys(
        keys.select(DATE_COLUMN, transcript_key(keys).alias("key")), digests, ["key"]
    )
    days = of_patients.select(DATE_COLUMN).union(of_texts.select(DATE_COLUMN)).distinct()
    return sorted(r[0] for r in days.collect())


def _around(named: DataFrame) -> list[date] | None:
    """The named days, the ones beside them (a stamp may name another zone) and the undated
    partition; None if an event names no day."""
    found = [r["day"] for r in named.distinct().collect()]
    if None in found:
        return None
    near = {day + timedelta(days=step) for day in found for step in (-1, 0, 1)}
    return sorted(near | {date.fromisoformat(UNDATED)})


def fold_into_table(
    spark: SparkSession, table: str, log: DataFrame, days: list[date] | None = None
) -> None:
    """Write the folded states into the partitions of the table that change.

    With ``days`` (``touched_days`` of the events that have come) no other day is read. The
    fold is written aside once; what changed is taken from there.
    """
    if days is not None and not days:
        return
    rows = scan_audit_table(spark, table, keep_batch=True, keep_digest=True)
    if days is not None:
        rows = rows.filter(F.col(DATE_COLUMN).isin(days))
    states = ["status", "pharmacy_status"]
    changed = F.struct(*states) != F.col("__before")
    folded = fold_status(rows.select("*", F.struct(*states).alias("__before")), log)
    aside = shared_folder(spark, "folded")
    marked = folded.withColumn("__changed", changed).drop("__before")
    marked.write.partitionBy(*PARTITION_COLUMNS).parquet(aside)
    written = spark.read.schema(marked.schema).parquet(aside)
    touched = written.filter("__changed").select(*PARTITION_COLUMNS).distinct()
    current = written.join(touched, PARTITION_COLUMNS, "left_semi").drop("__changed")
    overwrite_partitions(current.hint("rebalance", *PARTITION_COLUMNS), table, PARTITION_COLUMNS)
    drop_folder(spark, aside)
