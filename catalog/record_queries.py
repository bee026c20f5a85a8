"""Record view, deduplication, history, display and time columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.keyed_queries import FOLDED, status_events
from catalog.registry import query
from catalog.standins import HISTORY, RECORDS, iso, iso_sql, read, records
from wardbook import fixed_values as fv
from wardbook.functions import display, ids, timestamps
from wardbook.operators import counts, dedup, history
from wardbook.operators.keyed import last_per_key
from wardbook.plans.commit import records_to_commit
from wardbook.plans.records_view import records_view as view_of
from wardbook.plans.records_view import register_audits
from wardbook.sinks.json_rows import json_rows
from wardbook.sinks.table import audit_projection

_TABLE_LACKS = ("medication", "pharmacy_status")


def _flat(df: DataFrame) -> DataFrame:
    """List columns as text, so that any engine compares them alike."""
    lists = [c for c in ("symptoms", "lab_tests") if c in df.columns]
    return df.withColumns({c: F.array_join(c, "|") for c in lists})


def _view_sql(where: str = "TRUE", resolution: str = "day") -> str:
    return f"""WITH {RECORDS}, both_sides AS (
      SELECT *, 0 AS source FROM records
      UNION ALL BY NAME
      SELECT * EXCLUDE (medication, pharmacy_status), 1 AS source FROM records),
    ranked AS (
      SELECT *, row_number() OVER (
        PARTITION BY date_trunc('{resolution}', CAST("timestamp" AS TIMESTAMP)), raw_transcript
        ORDER BY CAST("timestamp" AS TIMESTAMP) DESC, source, event_id DESC) AS rn
      FROM both_sides WHERE {where})
    SELECT event_id, patient_id, array_to_string(symptoms, '|') AS symptoms, diagnosis,
      medication, dosage, array_to_string(lab_tests, '|') AS lab_tests, raw_transcript,
      strftime(CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS "timestamp",
      status, pharmacy_status
    FROM ranked WHERE rn = 1"""


def _view(spark: SparkSession, sf_dir: str, **choices) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("newest_id", -F.col("event_id"))
    table = rows.drop(*_TABLE_LACKS)
    choices.setdefault("resolution", "day")
    return _flat(view_of(rows, table, tie=["newest_id"], **choices).drop("newest_id"))


@query(_view_sql())
def records_view(spark, sf_dir):
    return _view(spark, sf_dir)


@query(_view_sql(f"status = '{fv.STATUS_PENDING_PHARMACY}'"))
def records_view_status(spark, sf_dir):
    return _view(spark, sf_dir, status=fv.STATUS_PENDING_PHARMACY)


@query(_view_sql("patient_id = '7'", "second"))
def records_view_patient(spark, sf_dir):
    return _view(spark, sf_dir, patient_id="7", resolution="second")


@query(_view_sql(resolution="second"))
def records_view_ordered(spark, sf_dir):
    return _view(spark, sf_dir, ordered=True, resolution="second")


def _current_sql(where: str = "TRUE") -> str:
    return f"""WITH {RECORDS}, {FOLDED}, both_sides AS (
      SELECT r.event_id, r.patient_id, r.raw_transcript, CAST(r."timestamp" AS TIMESTAMP) AS ts,
        f.status, f.pharmacy_status
      FROM records r JOIN folded f ON r.event_id = f.event_id),
    ranked AS (
      SELECT *, row_number() OVER (
        PARTITION BY date_trunc('second', ts), raw_transcript ORDER BY ts DESC, event_id DESC) AS rn
      FROM both_sides WHERE {where})
    SELECT event_id, patient_id, status, pharmacy_status FROM ranked WHERE rn = 1"""


def _current(spark: SparkSession, sf_dir: str, **choices) -> DataFrame:
    """Landing and table both hold the stored statuses; the log has what came since."""
    rows = records(spark, sf_dir).withColumn("newest_id", -F.col("event_id"))
    view = view_of(rows, rows, tie=["newest_id"], log=status_events(rows), **choices)
    return view.select("event_id", "patient_id", "status", "pharmacy_status")


@query(_current_sql())
def records_view_current(spark, sf_dir):
    return _current(spark, sf_dir)


@query(_current_sql(f"status = '{fv.STATUS_PENDING_PHARMACY}'"))
def records_view_pending_after_dispense(spark, sf_dir):
    return _current(spark, sf_dir, status=fv.STATUS_PENDING_PHARMACY)


@query(
    f"""SELECT event_id, patient_id, raw_transcript, status, "timestamp"
      FROM ({_view_sql(resolution="second")})"""
)
def audits_alias(spark, sf_dir):
    rows = records(spark, sf_dir)
    register_audits(rows, rows.drop(*_TABLE_LACKS, "event_id"))
    return spark.sql(
        "SELECT event_id, patient_id, raw_transcript, status, timestamp FROM audits"
    )


@query(
    f"""SELECT event_id, {iso_sql("ts")} AS ts, user_id, event_type, value, props FROM (
      SELECT *, row_number() OVER (
        PARTITION BY date_trunc('day', ts), props ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1"""
)
def dedup_keep_newest(spark, sf_dir):
    day = F.date_trunc("day", "ts")
    newest_id = F.col("event_id").desc()
    rows = read(spark, sf_dir, "events")
    kept = dedup.keep_newest(rows, [day, "props"], F.col("ts"), [newest_id])
    return kept.withColumn("ts", iso("ts"))


@query(
    """SELECT user_id, event_type, event_id, value FROM (
      SELECT *, row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1"""
)
def last_value_per_key(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return last_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    """SELECT event_id, user_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn <= 3"""
)
def last3_visits(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    last = dedup.last_visits(rows, "user_id", F.col("ts"), [F.col("event_id").desc()], 3)
    return last.select("event_id", "user_id", "event_type", "value")


@query(f"WITH {RECORDS}, {HISTORY} SELECT patient_id, history FROM history")
def history_json(spark, sf_dir):
    return history.patient_history(records(spark, sf_dir))


@query(
    f"""WITH {RECORDS} SELECT patient_id, "timestamp" AS date, coalesce(diagnosis, 'N/A') AS diagnosis,
      coalesce(medication, 'N/A') AS medication, symptoms[1] AS symptoms FROM records"""
)
def history_columns(spark, sf_dir):
    return _flat(history.visit_columns(records(spark, sf_dir)))


@query(
    f"""WITH {RECORDS} SELECT * EXCLUDE (symptoms, lab_tests) FROM (
      SELECT *, 'landing' AS source FROM records UNION ALL BY NAME
      SELECT * EXCLUDE (medication, pharmacy_status), 'table' AS source FROM records)"""
)
def union_widened(spark, sf_dir):
    rows = records(spark, sf_dir).drop("symptoms", "lab_tests")
    table = rows.drop(*_TABLE_LACKS).withColumn("source", F.lit("table"))
    return dedup.union_widened(rows.withColumn("source", F.lit("landing")), table)


@query(f"""SELECT event_id, {iso_sql("ts")} AS ts, event_type FROM events ORDER BY ts DESC, event_id""")
def newest_first(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    ordered = dedup.newest_first(rows, F.col("ts"), [F.col("event_id")])
    return ordered.withColumn("ts", iso("ts"))


@query(
    f"""WITH {RECORDS} SELECT "timestamp", patient_id, status FROM records
      ORDER BY "timestamp" DESC, event_id LIMIT 20"""
)
def latest_preview(spark, sf_dir):
    rows = dedup.newest_first(
        records(spark, sf_dir), F.col("timestamp"), [F.col("event_id")]
    )
    return audit_projection(dedup.preview(rows))


@query(
    f"""WITH {RECORDS} SELECT "timestamp", patient_id, status, FALSE AS is_leak,
      CAST(0.0 AS DOUBLE) AS risk_score FROM records WHERE raw_transcript IS NOT NULL"""
)
def audit_columns(spark, sf_dir):
    return records_to_commit(records(spark, sf_dir)).select(
        "timestamp", "patient_id", "status", "is_leak", "risk_score"
    )


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def nan_as_null(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
    return display.nan_to_null(rows.select("event_id", value.alias("value")))


@query(
    f"""WITH {RECORDS} SELECT status, count(*) AS records FROM records GROUP BY status"""
)
def pending_queue(spark, sf_dir):
    return counts.status_counts(records(spark, sf_dir))


@query("""SELECT count(*) AS "rows" FROM events""")
def row_count(spark, sf_dir):
    return counts.row_count(read(spark, sf_dir, "events"))


_DEFAULTED = "coalesce(nullif({0}, ''), '{1}') AS {0}"


def _defaults_sql(defaults: dict[str, str]) -> str:
    return ", ".join(_DEFAULTED.format(f'"{c}"', d) for c, d in defaults.items())


@query(
    f"""WITH {RECORDS} SELECT event_id, {_defaults_sql(fv.DASHBOARD_DEFAULTS)},
      CASE WHEN contains(status, 'pending') THEN 'pending'
        WHEN contains(status, 'completed') OR contains(status, 'dispensed') THEN 'completed'
        ELSE status END AS status_bucket FROM records"""
)
def display_defaults(spark, sf_dir):
    wanted = ["event_id", *fv.DASHBOARD_DEFAULTS, "status_bucket"]
    return display.dashboard_rows(records(spark, sf_dir)).select(*wanted)


@query(
    """SELECT event_id, CASE WHEN contains(event_type, 'pending') THEN 'pending'
      WHEN contains(event_type, 'completed') OR contains(event_type, 'dispensed') THEN 'completed'
      ELSE event_type END AS status_bucket FROM events"""
)
def status_bucket(spark, sf_dir):
    bucket = display.status_bucket(F.col("event_type")).alias("status_bucket")
    return read(spark, sf_dir, "events").select("event_id", bucket)


@query(
    f"""WITH {RECORDS} SELECT event_id, CASE WHEN contains(status, 'pending') THEN 'pending'
      WHEN contains(status, 'completed') OR contains(status, 'dispensed') THEN 'completed'
      ELSE status END AS status_bucket FROM records"""
)
def status_bucket_of_records(spark, sf_dir):
    bucket = display.status_bucket(F.col("status")).alias("status_bucket")
    return records(spark, sf_dir).select("event_id", bucket)


@query(f"WITH {RECORDS} SELECT event_id, {_defaults_sql(fv.PHARMACY_DEFAULTS)} FROM records")
def pharmacy_cards(spark, sf_dir):
    cards = display.pharmacy_cards(records(spark, sf_dir))
    return cards.select("event_id", *fv.PHARMACY_DEFAULTS)


def _timeline_sql(done: str) -> str:
    return f"""WITH {RECORDS} SELECT event_id, {_defaults_sql(fv.TIMELINE_DEFAULTS)},
      CASE WHEN status IN ({done}) THEN '{fv.DISPENSED_LABEL}' ELSE '{fv.NOT_DISPENSED_LABEL}' END
        AS medication_state,
      coalesce(len(symptoms) > 0, FALSE) AS has_symptoms,
      coalesce(len(lab_tests) > 0, FALSE) AS has_lab_tests FROM records"""


def _timeline(spark, sf_dir, accept_dispensed: bool) -> DataFrame:
    entries = display.timeline_entries(records(spark, sf_dir), accept_dispensed)
    flags = ["medication_state", "has_symptoms", "has_lab_tests"]
    return entries.select("event_id", *fv.TIMELINE_DEFAULTS, *flags)


@query(_timeline_sql("'fulfilled'"))
def patient_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir, accept_dispensed=False)


@query(_timeline_sql("'fulfilled', 'dispensed'"))
def patient_timeline_dispensed(spark, sf_dir):
    return _timeline(spark, sf_dir, accept_dispensed=True)


@query(
    f"""WITH {RECORDS} SELECT event_id,
      strftime(CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS seconds,
      strftime(CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d') AS calendar_date,
      strftime(CAST("timestamp" AS TIMESTAMP), '%b %-d, %Y') AS display_date,
      strftime(CAST("timestamp" AS TIMESTAMP), '%I:%M %p') AS display_time,
      strftime(CAST("timestamp" AS TIMESTAMP), '%Y%m%d_%H%M%S') AS file_stamp,
      strftime(CAST("timestamp" AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') AS utc_stamp,
      TRY_CAST(raw_transcript AS TIMESTAMP) IS NULL AS unreadable,
      split_part("timestamp", ' ', 1) AS first_token
    FROM records"""
)
def format_ts(spark, sf_dir):
    ts = timestamps.parse_timestamp(F.col("timestamp"))
    return records(spark, sf_dir).select(
        "event_id",
        timestamps.to_seconds_text(ts).alias("seconds"),
        timestamps.calendar_date(ts).alias("calendar_date"),
        timestamps.display_date(ts).alias("display_date"),
        timestamps.display_time(ts).alias("display_time"),
        ids.file_stamp(ts).alias("file_stamp"),
        timestamps.utc_stamp(ts).alias("utc_stamp"),
        timestamps.parse_timestamp(F.col("raw_transcript")).isNull().alias("unreadable"),
        timestamps.first_token(F.col("timestamp")).alias("first_token"),
    )


@query(
    """SELECT event_id, 'REQ-' || CAST(epoch(date_trunc('second', ts)) AS BIGINT) || '-'
        || substr(sha256(to_json({'user_id': user_id, 'event_type': event_type, 'props': props})), 1, 8)
        AS document_id, upper(event_type) AS normal_id
    FROM events"""
)
def document_ids(spark, sf_dir):
    content = [F.col(c) for c in ("user_id", "event_type", "props")]
    padded = F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))
    return read(spark, sf_dir, "events").select(
        "event_id",
        ids.document_id(fv.REQUEST_ID_PREFIX, F.col("ts"), *content).alias("document_id"),
        ids.normalise_id(padded).alias("normal_id"),
    )


@query(
    f"""WITH {RECORDS} SELECT to_json({{'event_id': event_id, 'patient_id': patient_id,
      'symptoms': symptoms, 'diagnosis': diagnosis, 'raw_transcript': raw_transcript,
      'pharmacy_status': pharmacy_status}})::VARCHAR AS json FROM records"""
)
def rows_as_json(spark, sf_dir):
    columns = ["event_id", "patient_id", "symptoms", "diagnosis", "raw_transcript", "pharmacy_status"]
    return json_rows(records(spark, sf_dir).select(*columns))
