"""Keyed updates, attachments and the patient bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import (
    CONVERSATIONS,
    HISTORY,
    LAB_REPORTS,
    LAB_REQUESTS,
    RECORDS,
    TRANSCRIPT_LINES,
    lab_reports,
    lab_requests,
    read,
    records,
    transcript_lines,
)
from wardbook import fixed_values as fv
from wardbook.operators import history, keyed
from wardbook.plans.extraction import conversations_from
from wardbook.plans.lab_loop import reports_of, request_queue
from wardbook.plans.status_log import fold_status
from wardbook.sinks.landing import dispense_events, update_events


@query(
    f"""WITH {LAB_REQUESTS}, {LAB_REPORTS} SELECT q.* REPLACE (
        CASE WHEN r.request_id IS NOT NULL THEN '{fv.REQUEST_COMPLETED}' ELSE q.status END AS status)
      FROM lab_requests q LEFT JOIN (
        SELECT DISTINCT request_id FROM lab_reports) r ON q.request_id = r.request_id"""
)
def complete_requests(spark, sf_dir):
    return keyed.complete_requests(lab_requests(spark, sf_dir), lab_reports(spark, sf_dir))


# Customers are the patients who have something dispensed, so that some patients
# of the orders are named and others are not.
_SERVED = "served AS (SELECT CAST(c_custkey AS VARCHAR) AS patient_id FROM customer WHERE c_acctbal < 0)"
_ORDER_RECORDS = """order_records AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS patient_id, o_orderstatus AS status,
    o_orderpriority AS pharmacy_status FROM orders)"""


def _order_records(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("pharmacy_status"),
    )


def _dispense_events(spark, sf_dir):
    served = read(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0)
    return served.select(F.col("c_custkey").cast("string").alias("patient_id"))


@query(
    f"""WITH {_SERVED}, {_ORDER_RECORDS} SELECT r.o_orderkey, r.patient_id,
        CASE WHEN s.patient_id IS NULL THEN r.status ELSE 'dispensed' END AS status,
        CASE WHEN s.patient_id IS NULL THEN r.pharmacy_status ELSE 'dispensed' END AS pharmacy_status
      FROM order_records r LEFT JOIN (SELECT DISTINCT patient_id FROM served) s
        ON r.patient_id = s.patient_id"""
)
def dispense(spark, sf_dir):
    return keyed.dispense(_order_records(spark, sf_dir), _dispense_events(spark, sf_dir))


@query(
    f"""WITH {RECORDS} SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS patient_id FROM customer
      WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT patient_id FROM records)"""
)
def unmatched_dispenses(spark, sf_dir):
    everyone = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("patient_id")
    )
    return keyed.unmatched_events(everyone, records(spark, sf_dir))


# Sign-ups name a day, errors a full stamp.
_UPDATES = """updates AS (
  SELECT event_id, raw_transcript, 'review ' || event_id AS status, "timestamp" AS event_time,
    CASE status WHEN 'completed' THEN substr("timestamp", 1, 10) ELSE "timestamp" END AS token
  FROM records WHERE status IN ('completed', 'fulfilled'))"""


def _updates(rows):
    named_day = F.concat(F.substring("timestamp", 1, 10), F.lit(" 00:00:00"))
    day = F.col("status") == "completed"
    return rows.filter(F.col("status").isin("completed", fv.STATUS_FULFILLED)).select(
        "event_id",
        "raw_transcript",
        F.concat(F.lit("review "), F.col("event_id").cast("string")).alias("status"),
        F.col("timestamp").alias("event_time"),
        F.when(day, named_day).otherwise(F.col("timestamp")).alias("timestamp"),
    )


@query(
    f"""WITH {RECORDS}, {_UPDATES}, latest AS (
      SELECT r.event_id, arg_max(u.status, u.event_time) AS status
      FROM records r JOIN updates u ON r.raw_transcript = u.raw_transcript
        AND contains(r."timestamp", u.token)
      GROUP BY r.event_id)
    SELECT r.event_id, r.raw_transcript, r."timestamp", coalesce(l.status, r.status) AS status
    FROM records r LEFT JOIN latest l ON r.event_id = l.event_id"""
)
def update_status(spark, sf_dir):
    rows = records(spark, sf_dir).select("event_id", "raw_transcript", "timestamp", "status")
    return keyed.update_status(rows, _updates(rows), ["event_time", "event_id"])


# A dispense of patients who saw a "view", and the updates from above, as one log.
FOLDED = f"""{_UPDATES}, served AS (
  SELECT patient_id, max("timestamp") AS at FROM records WHERE status = 'dispensed' GROUP BY patient_id),
latest AS (
  SELECT r.event_id, arg_max(u.status, u.event_time) AS status, max(u.event_time) AS at
  FROM records r JOIN updates u ON r.raw_transcript = u.raw_transcript
    AND contains(r."timestamp", u.token) AND r."timestamp" <= u.event_time
  GROUP BY r.event_id),
folded AS (
  SELECT r.event_id, r.patient_id,
    CASE WHEN s.at >= r."timestamp" AND (l.at IS NULL OR s.at >= l.at) THEN 'dispensed'
      ELSE coalesce(l.status, r.status) END AS status,
    CASE WHEN s.at >= r."timestamp" THEN 'dispensed' ELSE r.pharmacy_status END AS pharmacy_status
  FROM records r LEFT JOIN latest l ON r.event_id = l.event_id
  LEFT JOIN served s ON r.patient_id = s.patient_id)"""


def status_events(rows):
    """The log of FOLDED: dispenses carry no transcript."""
    viewed = rows.filter(F.col("status") == fv.STATUS_DISPENSED)
    dispenses = dispense_events(viewed, F.to_timestamp("timestamp"))
    updates = update_events(_updates(rows), F.to_timestamp("event_time"))
    return dispenses.unionByName(updates)


@query(f"WITH {RECORDS}, {FOLDED} SELECT event_id, patient_id, status, pharmacy_status FROM folded")
def status_log_fold(spark, sf_dir):
    rows = records(spark, sf_dir)
    current = fold_status(rows, status_events(rows))
    return current.select("event_id", "patient_id", "status", "pharmacy_status")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS report_id, o_orderpriority AS report_type,
      l.summary, l.risk_level FROM orders LEFT JOIN (
        SELECT l_orderkey, 'part ' || l_partkey AS summary, l_returnflag AS risk_level,
          row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn
        FROM lineitem) l ON o_orderkey = l_orderkey AND rn = 1"""
)
def latest_analysis(spark, sf_dir):
    reports = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("report_id"),
        F.col("o_orderpriority").alias("report_type"),
    )
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice"]
    analyses = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("report_id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("summary"),
        F.col("l_returnflag").alias("risk_level"),
        *order,
    )
    return keyed.attach_analyses(reports, analyses, order)


@query(
    f"""WITH {RECORDS}, {LAB_REPORTS}
    SELECT patient_id, 'record' AS kind, "timestamp" AS at, to_json({{'event_id': event_id,
      'raw_transcript': raw_transcript, 'timestamp': "timestamp", 'status': status}})::VARCHAR AS document
    FROM records UNION ALL
    SELECT patient_id, 'lab_report', date, to_json({{'report_id': report_id, 'date': date,
      'lab_tests': lab_tests, 'request_id': request_id}})::VARCHAR
    FROM lab_reports"""
)
def patient_bundle(spark, sf_dir):
    rows = records(spark, sf_dir).select(
        "event_id", "patient_id", "raw_transcript", "timestamp", "status"
    )
    reports = lab_reports(spark, sf_dir).drop("report_type", "file_path")
    return history.patient_bundle(rows, reports)


@query(
    f"""WITH {RECORDS}, {LAB_REPORTS}, r AS (
      SELECT patient_id, count(*) AS records, max("timestamp") AS last_record
      FROM records GROUP BY patient_id),
    l AS (
      SELECT patient_id, count(*) AS lab_reports, max(date) AS last_report
      FROM lab_reports GROUP BY patient_id)
    SELECT coalesce(r.patient_id, l.patient_id) AS patient_id, coalesce(records, 0) AS records,
      last_record, coalesce(lab_reports, 0) AS lab_reports, last_report
    FROM r FULL JOIN l ON r.patient_id = l.patient_id"""
)
def patient_overview(spark, sf_dir):
    return history.patient_overview(records(spark, sf_dir), lab_reports(spark, sf_dir))


@query(
    f"""WITH {RECORDS}, {HISTORY}, {TRANSCRIPT_LINES}, {CONVERSATIONS}
    SELECT consult_id, consult_id AS patient_id, conversation,
      coalesce(history, '{fv.NO_HISTORY}') AS history
    FROM consultations LEFT JOIN history ON consult_id = patient_id"""
)
def attach_history(spark, sf_dir):
    conversations = conversations_from(transcript_lines(spark, sf_dir))
    with_patient = conversations.withColumn("patient_id", F.col("consult_id"))
    return history.attach_history(with_patient, history.patient_history(records(spark, sf_dir)))


@query(f"WITH {LAB_REQUESTS} SELECT * FROM lab_requests WHERE status = '{fv.REQUEST_PENDING}'")
def pending_requests(spark, sf_dir):
    return request_queue(lab_requests(spark, sf_dir))


@query(
    f"""WITH {LAB_REQUESTS}, {LAB_REPORTS} SELECT * FROM lab_requests
      WHERE status = '{fv.REQUEST_PENDING}' AND request_id NOT IN (
        SELECT request_id FROM lab_reports WHERE request_id IS NOT NULL)"""
)
def open_requests(spark, sf_dir):
    return request_queue(lab_requests(spark, sf_dir), lab_reports(spark, sf_dir))


@query(
    f"""WITH {LAB_REPORTS} SELECT report_id, patient_id, date, request_id FROM lab_reports
      WHERE patient_id = '3'"""
)
def patient_reports(spark, sf_dir):
    return reports_of(lab_reports(spark, sf_dir), "3").select(
        "report_id", "patient_id", "date", "request_id"
    )
