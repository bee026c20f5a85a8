"""Landing folders, the audit table and the streams between them.

Each query writes the given tables to the shared folder in the documents' form
and reads them back through the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.keyed_queries import FOLDED, status_events
from catalog.registry import query
from catalog.standins import (
    HISTORY,
    LAB_REPORTS,
    LAB_REQUESTS,
    RECORDS,
    lab_reports,
    lab_requests,
    read,
    records,
    transcript_lines,
)
from wardbook import fixed_values as fv
from wardbook import schemas
from wardbook.functions.transcript import keyword_risk
from wardbook.operators import keyed
from wardbook.plans import recent_visits
from wardbook.plans.commit import commit_landing
from wardbook.plans.lab_loop import reports_of
from wardbook.plans.records_view import current_records
from wardbook.plans.status_log import pending_queue as pending_of
from wardbook.session import Folder, shared_folder
from wardbook.sinks.compaction import compact
from wardbook.sinks.landing import approved_records, lab_reports_from, lab_requests_from, land
from wardbook.sinks.table import append_to_table
from wardbook.sources import documents
from wardbook.sources.inventory import area_totals, folder_files, table_files
from wardbook.sources.table import scan_audit_table
from wardbook.streaming.ingest import ingest_folder, quarantine_of
from wardbook.streaming.lab import ingest_lab, scan_lab
from wardbook.streaming.queue import log_status_events, status_log

_RECORD_COLUMNS = """patient_id, array_to_string(symptoms, '|') AS symptoms, diagnosis,
  medication, dosage, array_to_string(lab_tests, '|') AS lab_tests, raw_transcript, "timestamp",
  status, pharmacy_status"""


def _flat(df: DataFrame) -> DataFrame:
    lists = [c for c in ("symptoms", "lab_tests") if c in df.columns]
    return df.withColumns({c: F.array_join(c, "|") for c in lists})


def _landed(spark: SparkSession, rows: DataFrame, label: str) -> str:
    path = shared_folder(spark, label)
    land(rows, path, compressed=True)
    return path


def _clinical_folder(spark: SparkSession, sf_dir: str) -> str:
    return _landed(spark, records(spark, sf_dir).drop("event_id"), "clinical")


@query(f"WITH {RECORDS} SELECT {_RECORD_COLUMNS} FROM records")
def scan_clinical(spark, sf_dir):
    return _flat(documents.scan_clinical(spark, _clinical_folder(spark, sf_dir), "lines"))


# An "error" event stands for a document cut off before its end.
_CUT = "'{\"patient_id\": \"' || user_id || '\", \"status\": \"' || event_type"


def _texts(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "texts")
    start = F.concat(
        F.lit('{"patient_id": "'),
        F.col("user_id").cast("string"),
        F.lit('", "status": "'),
        F.col("event_type"),
    )
    document = F.when(F.col("event_type") == "error", start).otherwise(F.concat(start, F.lit('"}')))
    read(spark, sf_dir, "events").select(document.alias("value")).write.text(path)
    return path


@query(f"SELECT {_CUT} AS document FROM events WHERE event_type = 'error'")
def quarantine(spark, sf_dir):
    path = _texts(spark, sf_dir)
    bad = documents.quarantine(spark, path, schemas.CLINICAL_RECORD, "lines", "*.txt")
    return bad.select("document")


@query(
    "SELECT CAST(user_id AS VARCHAR) AS patient_id, event_type AS status FROM events"
    " WHERE event_type <> 'error'"
)
def readable_documents(spark, sf_dir):
    path = _texts(spark, sf_dir)
    rows = documents.readable(spark, path, schemas.CLINICAL_RECORD, "lines", "*.txt")
    return rows.select("patient_id", "status")


@query(
    "SELECT CAST(user_id AS VARCHAR) AS patient_id, unnest([event_type, props]) AS status FROM events"
)
def array_documents(spark, sf_dir):
    """Every line holds an array of two documents."""
    patient = F.col("user_id").cast("string").alias("patient_id")
    pair = F.array(
        F.struct(patient, F.col("event_type").alias("status")),
        F.struct(patient, F.col("props").alias("status")),
    )
    path = shared_folder(spark, "arrays")
    read(spark, sf_dir, "events").select(F.to_json(pair)).write.text(path)
    rows = documents.readable(spark, path, schemas.CLINICAL_RECORD, "lines", "*.txt")
    return rows.select("patient_id", "status")


#: Documents of a pretty-printed file, some 500 bytes each.
_PRETTY = 2_000


@query(f"WITH {RECORDS} SELECT {_RECORD_COLUMNS} FROM records")
def pretty_documents(spark, sf_dir):
    """Files that each hold one array of documents over many lines.

    Row numbers are distinct, so a file has at most ``_PRETTY`` documents, and larger tables
    have more files.
    """
    row = F.monotonically_increasing_id()
    rows = records(spark, sf_dir).withColumn("file", F.floor(row / F.lit(_PRETTY)))
    pretty = F.to_json(
        F.collect_list(F.struct(*schemas.CLINICAL_RECORD.names)), {"pretty": "true"}
    )
    files = rows.groupBy("file").agg(pretty.alias("value")).select("value")
    path = shared_folder(spark, "pretty")
    files.write.option("maxRecordsPerFile", 1).text(path)
    return _flat(documents.readable(spark, path, schemas.CLINICAL_RECORD, "document", "*.txt"))


def _mixed_folder(spark: SparkSession, sf_dir: str) -> str:
    """Lines, pretty-printed arrays and single pretty documents in one folder."""
    rows = records(spark, sf_dir)
    path = shared_folder(spark, "mixed")
    land(rows.filter(F.col("event_id") % 2 == 0).drop("event_id"), path)
    odd = rows.filter(F.col("event_id") % 2 == 1).withColumn(
        "file", F.floor(F.monotonically_increasing_id() / F.lit(_PRETTY))
    )
    pretty = F.to_json(
        F.collect_list(F.struct(*schemas.CLINICAL_RECORD.names)), {"pretty": "true"}
    )
    files = odd.groupBy("file").agg(pretty.alias("value")).select("value")
    aside = shared_folder(spark, "pretty")
    files.write.option("maxRecordsPerFile", 1).text(aside)
    for file in Folder(spark, aside).children():
        if "/part-" in file:
            name = file.rsplit("/", 1)[1].replace(".txt", ".json")
            Folder(spark, file).move_to(f"{path}/{name}")
    return path


@query(f"WITH {RECORDS} SELECT {_RECORD_COLUMNS} FROM records")
def mixed_documents(spark, sf_dir):
    """A folder of several layouts; each file's is found."""
    return _flat(documents.scan_clinical(spark, _mixed_folder(spark, sf_dir), "auto"))


@query(
    f"""WITH {RECORDS} SELECT {_RECORD_COLUMNS} FROM records WHERE raw_transcript IS NOT NULL"""
)
def ingest_mixed(spark, sf_dir):
    """The same folder through the stream."""
    landing, table = _mixed_folder(spark, sf_dir), shared_folder(spark, "audit")
    ingest_folder(spark, landing, table, shared_folder(spark, "checkpoint")).awaitTermination()
    return _flat(scan_audit_table(spark, table).select(*schemas.CLINICAL_RECORD.names))


@query(
    f"""WITH {RECORDS} SELECT patient_id, raw_transcript, "timestamp" FROM records
      WHERE status <> 'completed'"""
)
def commit_without_transcript(spark, sf_dir):
    """Documents of one status lack their transcript and are not committed."""
    rows = records(spark, sf_dir)
    heard = F.when(F.col("status") != "completed", F.col("raw_transcript"))
    table = shared_folder(spark, "audit")
    commit_landing(rows.withColumn("raw_transcript", heard), table)
    return scan_audit_table(spark, table).select("patient_id", "raw_transcript", "timestamp")


@query("SELECT event_id, user_id, event_type AS kind, value FROM events")
def union_of_keys(spark, sf_dir):
    """Documents of one folder that share no schema."""
    rows = read(spark, sf_dir, "events")
    path = shared_folder(spark, "keys")
    named = rows.selectExpr("event_id", "user_id", "event_type kind", "value")
    land(named.filter("kind = 'view'"), path)
    land(named.filter("kind <> 'view'").select("value", "kind", "user_id", "event_id"), path)
    return documents.scan_union_of_keys(spark, path, "lines")


#: Documents of one kind that a named file holds at most.
_NAMED = 20_000


@query(
    f"""SELECT 'clinical' AS area, event_type || '-' || (event_id // {_NAMED}) || '.json' AS file_name,
        count(*) FILTER (WHERE event_id % 10 > 0) AS records,
        count(*) FILTER (WHERE event_id % 10 = 0) AS damaged
      FROM events GROUP BY event_type, event_id // {_NAMED}
      UNION ALL SELECT 'clinical', 'empty.json', 0, 0
      UNION ALL SELECT 'table', 'all', count(*), 0 FROM orders"""
)
def source_inventory(spark, sf_dir):
    """Files by name, with damaged documents, one without a byte, and a table's total."""
    name = F.concat_ws("-", "event_type", F.floor(F.col("event_id") / _NAMED).cast("string"))
    document = F.to_json(F.struct(F.col("user_id").cast("string").alias("patient_id")))
    cut = F.when(F.col("event_id") % 10 == 0, F.lit('{"patient_id": ')).otherwise(document)
    texts = read(spark, sf_dir, "events").select(cut.alias("value"), name.alias("name"))
    path, aside = shared_folder(spark, "named"), shared_folder(spark, "unnamed")
    texts.repartition("name").write.partitionBy("name").text(aside)
    for step in Folder(spark, aside).partitions():
        (file,) = [f for f in Folder(spark, f"{aside}/{step}").children() if "/part-" in f]
        Folder(spark, file).move_to(f"{path}/{step.removeprefix('name=')}.json")
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{aside}/empty")
    (file,) = [f for f in Folder(spark, f"{aside}/empty").children() if "/part-" in f]
    Folder(spark, file).move_to(f"{path}/empty.json")
    table = shared_folder(spark, "table")
    lab_requests(spark, sf_dir).write.parquet(table)
    clinical = folder_files(spark, "clinical", path, schemas.CLINICAL_RECORD, "lines")
    total = area_totals(table_files(spark, "table", table)).select(
        "area", F.lit("all").alias("file_name"), "records", "damaged"
    )
    return clinical.drop("length").unionByName(total)


@query(
    f"""WITH {RECORDS} SELECT {_RECORD_COLUMNS} FROM (SELECT * REPLACE (
      'pending_pharmacy' AS status, 'pending' AS pharmacy_status) FROM records)"""
)
def land_records(spark, sf_dir):
    drafts = records(spark, sf_dir)
    at = F.to_timestamp("timestamp")
    path = _landed(spark, approved_records(drafts, at), "approved")
    return _flat(documents.scan_clinical(spark, path, "lines"))


@query(
    f"""WITH {LAB_REPORTS} SELECT patient_id, report_type, date, request_id,
      'lab_reports/lab_' || patient_id || '_' || date || '.pdf' AS file_path,
      'LAB-' || CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) AS id_start,
      array_to_string(list_transform(lab_tests, lambda t: t.test_name || '=' || t.value), '|') AS tests
    FROM lab_reports"""
)
def land_lab_reports(spark, sf_dir):
    uploads = lab_reports(spark, sf_dir).withColumns(
        {"lab_tests": F.to_json("lab_tests"), "file_name": F.lit("scan.pdf")}
    )
    path = _landed(spark, lab_reports_from(uploads, F.to_timestamp("date")), "reports")
    landed = documents.scan_lab_reports(spark, path, "lines")
    tests = F.transform("lab_tests", lambda t: F.concat(t["test_name"], F.lit("="), t["value"]))
    return landed.select(
        "patient_id",
        "report_type",
        "date",
        "request_id",
        "file_path",
        F.regexp_extract("report_id", r"^(.*)-", 1).alias("id_start"),
        F.array_join(tests, "|").alias("tests"),
    )


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS patient_id, o_orderpriority AS test_type,
      CASE WHEN o_orderstatus = 'F' THEN 'DOC-001' ELSE o_orderstatus END AS requested_by,
      strftime(o_orderdate, '%Y-%m-%d') AS date, 'Pending' AS status,
      'REQ-' || CAST(epoch(o_orderdate) AS BIGINT) AS id_start FROM orders"""
)
def land_lab_requests(spark, sf_dir):
    status = F.col("o_orderstatus")
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.col("o_orderpriority").alias("test_type"),
        F.when(status != "F", status).alias("requested_by"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    path = _landed(spark, lab_requests_from(orders, F.col("at")), "requests")
    landed = documents.scan_lab_requests(spark, path, "lines")
    id_start = F.regexp_extract("request_id", r"^(.*)-", 1)
    return landed.withColumn("id_start", id_start).drop("request_id")


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS status, text AS raw_transcript,
      CASE WHEN regexp_matches(lower(text), 'the|que') THEN CAST(0.9 AS DOUBLE)
        ELSE CAST(0.1 AS DOUBLE) END AS risk_score FROM conversations"""
)
def scan_goods_receipts(spark, sf_dir):
    logs = transcript_lines(spark, sf_dir).select(
        F.lit(None).cast("string").alias("timestamp"),
        F.col("text").alias("raw_transcript"),
        F.col("consult_id").alias("status"),
    )
    scanned = documents.scan_goods_receipts(spark, _landed(spark, logs, "receipts"), "lines")
    score = keyword_risk(F.col("raw_transcript"), ("the", "que")).alias("risk_score")
    return scanned.select("status", "raw_transcript", score)


@query(
    f"""WITH {RECORDS} SELECT {_RECORD_COLUMNS}, FALSE AS is_leak, CAST(0.0 AS DOUBLE) AS risk_score,
      strftime(CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d') AS event_date FROM records"""
)
def append_audit(spark, sf_dir):
    landing = documents.scan_clinical(spark, _clinical_folder(spark, sf_dir), "lines")
    table = shared_folder(spark, "audit")
    commit_landing(landing, table)
    rows = scan_audit_table(spark, table)
    return _flat(rows).withColumn("event_date", F.col("event_date").cast("string"))


@query(
    f"""WITH {RECORDS} SELECT "timestamp", raw_transcript, status, patient_id, is_leak, risk_score FROM (
      SELECT "timestamp", raw_transcript, status, NULL AS patient_id, NULL AS is_leak,
        CAST(0.1 AS DOUBLE) AS risk_score FROM records
      UNION ALL SELECT "timestamp", raw_transcript, status, patient_id, FALSE, 0.0 FROM records)"""
)
def audit_table_scan(spark, sf_dir):
    """A table whose older files lack the newer columns."""
    rows = records(spark, sf_dir)
    table = shared_folder(spark, "audit")
    older = rows.select("timestamp", "raw_transcript", "status").withColumn(
        "risk_score", F.lit(0.1)
    )
    append_to_table(older, table, schemas.AUDIT_RECORD_V0)
    commit_landing(rows, table)
    return scan_audit_table(spark, table).select(
        "timestamp", "raw_transcript", "status", "patient_id", "is_leak", "risk_score"
    )


@query(
    f"""WITH {RECORDS} SELECT {_RECORD_COLUMNS}, FALSE AS is_leak, CAST(0.0 AS DOUBLE) AS risk_score
      FROM records WHERE raw_transcript IS NOT NULL"""
)
def ingest_twice(spark, sf_dir):
    landing = _clinical_folder(spark, sf_dir)
    table, checkpoint = shared_folder(spark, "audit"), shared_folder(spark, "checkpoint")
    for _ in range(2):
        ingest_folder(spark, landing, table, checkpoint, "lines").awaitTermination()
    return _flat(scan_audit_table(spark, table).drop("event_date"))


# As in _CUT, with a transcript, so that P1 keeps the whole ones.
_HEARD = "'{\"patient_id\": \"' || user_id || '\", \"raw_transcript\": \"' || event_id"


@query(
    f"""SELECT 'committed' AS kind, user_id || ':' || event_id AS text FROM events
      WHERE event_type <> 'error'
      UNION ALL SELECT 'quarantined', {_HEARD} FROM events WHERE event_type = 'error'"""
)
def ingest_with_damage(spark, sf_dir):
    """Damaged documents of a batch are set aside, the others committed."""
    start = F.concat(
        F.lit('{"patient_id": "'),
        F.col("user_id").cast("string"),
        F.lit('", "raw_transcript": "'),
        F.col("event_id").cast("string"),
    )
    whole = F.col("event_type") != "error"
    landing, table = shared_folder(spark, "texts"), shared_folder(spark, "audit")
    texts = read(spark, sf_dir, "events").select(
        F.when(whole, F.concat(start, F.lit('"}'))).otherwise(start).alias("value")
    )
    texts.write.text(landing)
    checkpoint = shared_folder(spark, "checkpoint")
    for _ in range(2):
        ingest_folder(spark, landing, table, checkpoint, files="*.txt").awaitTermination()
    committed = scan_audit_table(spark, table).select(
        F.lit("committed").alias("kind"), F.concat_ws(":", "patient_id", "raw_transcript").alias("text")
    )
    bad = spark.read.parquet(quarantine_of(table))
    return committed.unionByName(
        bad.select(F.lit("quarantined").alias("kind"), F.col("document").alias("text"))
    )


@query(
    f"""WITH {RECORDS} SELECT * EXCLUDE (rn) REPLACE (
        strftime(CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS "timestamp")
      FROM (SELECT patient_id, raw_transcript, "timestamp", status, row_number() OVER (
          PARTITION BY date_trunc('second', CAST("timestamp" AS TIMESTAMP)), raw_transcript
          ORDER BY CAST("timestamp" AS TIMESTAMP) DESC) AS rn FROM records)
      WHERE rn = 1"""
)
def records_view_half_ingested(spark, sf_dir):
    """Half of the documents are in the table, the others land later; both are seen once."""
    rows = records(spark, sf_dir)
    landing, table = shared_folder(spark, "clinical"), shared_folder(spark, "audit")
    half = F.col("event_id") % 2 == 0
    land(rows.filter(half).drop("event_id"), landing)
    ingest_folder(spark, landing, table, shared_folder(spark, "checkpoint")).awaitTermination()
    land(rows.filter(~half).drop("event_id"), landing)
    view = current_records(spark, landing, table)
    return view.select("patient_id", "raw_transcript", "timestamp", "status")


@query(f"WITH {RECORDS}, {HISTORY} SELECT patient_id, history FROM history")
def kept_history(spark, sf_dir):
    """The last visits kept by three arrivals, cut together in between."""
    rows = records(spark, sf_dir)
    landing, table, visits = (shared_folder(spark, x) for x in ("clinical", "audit", "visits"))
    checkpoint = shared_folder(spark, "checkpoint")
    for part in range(3):
        land(rows.filter(F.col("event_id") % 3 == part).drop("event_id"), landing)
        ingest_folder(spark, landing, table, checkpoint, visits=visits).awaitTermination()
        if part == 1:
            recent_visits.compact_visits(spark, visits)
    return recent_visits.kept_history(spark, visits)


@query(
    f"""WITH {RECORDS} SELECT {_RECORD_COLUMNS},
      strftime(CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d') AS event_date FROM records"""
)
def compacted_table(spark, sf_dir):
    """The table after the batches of all but the newest arrival are brought together."""
    rows = records(spark, sf_dir)
    landing, table = shared_folder(spark, "clinical"), shared_folder(spark, "audit")
    checkpoint = shared_folder(spark, "checkpoint")
    for part in range(3):
        land(rows.filter(F.col("event_id") % 3 == part).drop("event_id"), landing)
        ingest_folder(spark, landing, table, checkpoint).awaitTermination()
    compact(spark, table, schema=schemas.AUDIT_TABLE)
    found = scan_audit_table(spark, table)
    return _flat(found.select(*schemas.CLINICAL_RECORD.names, F.col("event_date").cast("string")))


def _lab_table(spark: SparkSession, kind: str, *arrivals: DataFrame) -> str:
    """A lab table from arrivals whose folder is emptied in between."""
    table, checkpoint = shared_folder(spark, kind), shared_folder(spark, "checkpoint")
    landing = shared_folder(spark, "landing")
    for rows in arrivals:
        land(rows, landing, compressed=True)
        ingest_lab(spark, kind, landing, table, checkpoint).awaitTermination()
        for file in Folder(spark, landing).children():
            Folder(spark, file).delete()
    return table


@query(
    f"""WITH {LAB_REQUESTS}, {LAB_REPORTS} SELECT q.* REPLACE (
        CASE WHEN r.request_id IS NOT NULL THEN '{fv.REQUEST_COMPLETED}' ELSE q.status END AS status)
      FROM lab_requests q LEFT JOIN (
        SELECT DISTINCT request_id FROM lab_reports) r ON q.request_id = r.request_id"""
)
def completed_for_good(spark, sf_dir):
    """Reports complete their requests although their folder is emptied after each arrival."""
    reports = lab_reports(spark, sf_dir)
    odd = F.crc32(F.col("report_id").cast("binary")) % 2 == 1
    kept = _lab_table(spark, "reports", reports.filter(odd), reports.filter(~odd))
    asked = _lab_table(spark, "requests", lab_requests(spark, sf_dir))
    return keyed.complete_requests(
        scan_lab(spark, "requests", asked), scan_lab(spark, "reports", kept)
    )


@query(
    f"""WITH {LAB_REPORTS} SELECT report_id, patient_id, date, request_id FROM lab_reports
      WHERE patient_id = '3'"""
)
def patient_reports_table(spark, sf_dir):
    """One patient's reports from the table of reports."""
    table = _lab_table(spark, "reports", lab_reports(spark, sf_dir))
    return reports_of(scan_lab(spark, "reports", table), "3").select(
        "report_id", "patient_id", "date", "request_id"
    )


def _streamed_log(spark: SparkSession, rows: DataFrame, table: str | None = None) -> str:
    events = _landed(spark, status_events(rows), "events")
    log, checkpoint = shared_folder(spark, "log"), shared_folder(spark, "checkpoint")
    log_status_events(spark, events, log, checkpoint, table).awaitTermination()
    return log


@query(
    f"""WITH {RECORDS}, {FOLDED} SELECT event_id, patient_id FROM folded
      WHERE status = '{fv.STATUS_PENDING_PHARMACY}'"""
)
def queue_stream(spark, sf_dir):
    rows = records(spark, sf_dir)
    log = status_log(spark, _streamed_log(spark, rows))
    return pending_of(rows, log).select("event_id", "patient_id")


@query(
    f"""WITH {RECORDS}, {FOLDED} SELECT r."timestamp", f.patient_id, f.status, f.pharmacy_status
      FROM folded f JOIN records r ON f.event_id = r.event_id"""
)
def status_into_table(spark, sf_dir):
    rows = records(spark, sf_dir)
    table = shared_folder(spark, "audit")
    commit_landing(rows, table)
    _streamed_log(spark, rows, table)
    return scan_audit_table(spark, table).select(
        "timestamp", "patient_id", "status", "pharmacy_status"
    )
