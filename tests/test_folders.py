from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_operators import EVENTS, STATES, _fold_by_hand, random_status_case

from wardbook import jobs, schemas
from wardbook.plans.commit import commit_landing
from wardbook.plans.status_log import fold_into_table
from wardbook.session import shared_folder
from wardbook.sinks.json_rows import json_rows, write_json
from wardbook.sinks.landing import approved_records, lab_reports_from, lab_requests_from, land
from wardbook.sinks.table import append_to_table, replace_partitions, write_batch
from wardbook.sources import documents
from wardbook.sources.inventory import area_totals, folder_files, inventory, table_files
from wardbook.sources.table import scan_any_columns, scan_audit_table
from wardbook.streaming.batches import start_batches
from wardbook.streaming.ingest import (
    committed_rows,
    ingest_folder,
    quarantine_of,
    quarantined_rows,
)
from wardbook.streaming.queue import log_status_events, status_log


def record(number: int, **fields) -> dict:
    return {
        "patient_id": f"PAT-{number}",
        "symptoms": ["cough"],
        "diagnosis": "cold",
        "medication": "rest",
        "dosage": "daily",
        "lab_tests": [],
        "raw_transcript": f"Doctor: visit {number}\nPatient: ನಮಸ್ಕಾರ",
        "timestamp": f"2026-03-{number % 3 + 1:02d}T10:00:{number % 60:02d}.000{number % 1000:03d}",
        "status": "pending_pharmacy",
        **fields,
    }


@pytest.fixture
def landing(folder):
    path = Path(folder("landing"))
    path.mkdir()
    return path


def put(path: Path, name: str, content) -> None:
    text = content if isinstance(content, str) else json.dumps(content, indent=4)
    (path / name).write_text(text)


# -- scans --------------------------------------------------------------------------


def test_scan_reads_direct_children_of_any_form(spark, landing):
    put(landing, "one.json", record(1, pharmacy_status="pending"))
    put(landing, "many.json", [record(2), record(3)])
    put(landing, "empty_object.json", {})
    put(landing, "empty.json", "")
    put(landing, "broken.json", '{"patient_id": "PAT-9", "raw_tr')
    put(landing, "quotes.json", "{'patient_id': 'PAT-9', 'raw_transcript': 'x'}")
    put(landing, "notes.txt", record(8))
    (landing / "lab_reports").mkdir()
    put(landing / "lab_reports", "r.json", record(7))
    rows = documents.scan_clinical(spark, str(landing), "document")
    found = rows.filter("raw_transcript is not null").select("patient_id", "pharmacy_status")
    assert rows_of(found) == [("PAT-1", "pending"), ("PAT-2", None), ("PAT-3", None)]
    good = documents.readable(spark, str(landing), schemas.CLINICAL_RECORD, "document")
    assert good.count() == 4
    bad = documents.quarantine(spark, str(landing), schemas.CLINICAL_RECORD, "document")
    assert bad.count() == 2
    row = bad.orderBy("file_path").first()
    assert row["file_path"].endswith("broken.json") and row["document"].startswith('{"patient_id"')


def test_scan_of_lines(spark, landing):
    put(landing, "a.json", "\n".join(json.dumps(record(i)) for i in range(5)) + "\n{cut")
    rows = documents.readable(spark, str(landing), schemas.CLINICAL_RECORD, "lines")
    assert rows.count() == 5
    with pytest.raises(ValueError, match="layout"):
        documents.scan_clinical(spark, str(landing), "columns")


def test_absent_fields_are_null(spark, landing):
    put(landing, "r.json", {"report_id": "R", "patient_id": "P", "lab_tests": [{"test_name": "Iron"}]})
    row = documents.scan_lab_reports(spark, str(landing), "document").first().asDict(recursive=True)
    assert row["request_id"] is None
    assert row["lab_tests"] == [
        {"test_name": "Iron", "value": None, "normal_range": None, "status": None}
    ]
    put(landing, "q.json", {"request_id": "Q", "status": "Pending"})
    requests = documents.scan_lab_requests(spark, str(landing), "document").filter("request_id is not null")
    assert requests.first()["requested_by"] is None


def test_union_of_keys(spark, landing):
    put(landing, "a.json", {"x": 1})
    put(landing, "b.json", {"y": "t"})
    assert documents.scan_union_of_keys(spark, str(landing), "document").columns == ["x", "y"]


def test_inventory(spark, landing, folder):
    put(landing, "a.json", [record(1), record(2)])
    put(landing, "b.json", record(3))
    put(landing, "empty.json", "")
    put(landing, "broken.json", '{"patient_id": "PAT-9", "raw_tr')
    put(landing, "mixed [1].json", json.dumps(record(4)) + "\n{cut")
    table = folder("audit")
    commit_landing(spark.createDataFrame([record(5), record(6)], schemas.CLINICAL_RECORD).coalesce(1), table)
    clinical = folder_files(spark, "clinical", str(landing), schemas.CLINICAL_RECORD)
    found = rows_of(clinical.select("area", "file_name", "records", "damaged"))
    assert found == [
        ("clinical", "a.json", 2, 0), ("clinical", "b.json", 1, 0), ("clinical", "broken.json", 0, 1),
        ("clinical", "empty.json", 0, 0), ("clinical", "mixed [1].json", 1, 1),
    ]
    sizes = {r.file_name: r.length for r in clinical.collect()}
    assert sizes["empty.json"] == 0 and sizes["a.json"] == (landing / "a.json").stat().st_size
    files = inventory([clinical, table_files(spark, "table", table)])
    days = len(list(Path(table).glob("event_date=*/ingest_batch=*/*.parquet")))
    assert rows_of(area_totals(files)) == [("clinical", 5, 4, 2), ("table", days, 2, 0)]


# -- landing sinks --------------------------------------------------------------------


def test_approved_records_land_and_scan_back(spark, folder):
    drafts = spark.createDataFrame([record(1), record(2)], schemas.CLINICAL_RECORD)
    at = F.lit("2026-05-01 01:02:03.000004").cast("timestamp")
    for one_per_file, layout in ((False, "lines"), (True, "document")):
        path = folder("approved")
        land(approved_records(drafts.coalesce(1), at), path, one_per_file)
        back = documents.scan_clinical(spark, path, layout)
        assert rows_of(back.select("patient_id", "timestamp", "status", "pharmacy_status")) == [
            ("PAT-1", "2026-05-01T01:02:03.000004", "pending_pharmacy", "pending"),
            ("PAT-2", "2026-05-01T01:02:03.000004", "pending_pharmacy", "pending"),
        ]
        assert len([f for f in os.listdir(path) if f.endswith(".json")]) == (2 if one_per_file else 1)


def test_lab_documents(spark):
    at = F.lit("2026-05-01 01:02:03").cast("timestamp")
    uploads = spark.createDataFrame(
        [("P", "Blood", '[{"test_name":"Iron"}]', None, "scan.pdf"), ("P", "Blood", "oops", "Q1", None)],
        "patient_id string, report_type string, lab_tests string, request_id string, file_name string",
    )
    rows = lab_reports_from(uploads, at).collect()
    assert [r["file_path"] for r in rows] == ["lab_reports/lab_P_2026-05-01.pdf", None]
    assert [len(r["lab_tests"]) for r in rows] == [1, 0]
    assert len({r["report_id"] for r in rows}) == 2
    assert lab_reports_from(uploads, at).schema.names == schemas.LAB_REPORT.names
    orders = spark.createDataFrame(
        [("P", "Blood", None), ("P", "Blood", "DOC-7")],
        "patient_id string, test_type string, requested_by string",
    )
    requests = lab_requests_from(orders, at)
    assert requests.schema.names == schemas.LAB_REQUEST.names
    assert [(r["requested_by"], r["date"], r["status"]) for r in requests.collect()] == [
        ("DOC-001", "2026-05-01", "Pending"), ("DOC-7", "2026-05-01", "Pending"),
    ]


def test_json_rows_keep_nulls(spark, folder):
    frame = spark.createDataFrame([("a", None, ["x"])], "p string, q string, r array<string>")
    assert json_rows(frame).first()[0] == '{"p":"a","q":null,"r":["x"]}'
    path = folder("json")
    write_json(frame, path)
    assert spark.read.text(path).first()[0] == '{"p":"a","q":null,"r":["x"]}'


# -- audit table ------------------------------------------------------------------------


def test_commit_counts_and_fills_the_audit_columns(spark, landing, folder):
    put(landing, "a.json", [record(1), record(2, timestamp="junk")])
    put(landing, "b.json", {})
    table = folder("audit")
    rows = documents.scan_clinical(spark, str(landing), "document")
    assert commit_landing(rows, table) == 2
    back = scan_audit_table(spark, table)
    assert rows_of(back.select("patient_id", "is_leak", "risk_score", F.col("event_date").cast("string"))) == [
        ("PAT-1", False, 0.0, "2026-03-02"), ("PAT-2", False, 0.0, "1970-01-01"),
    ]
    assert commit_landing(rows.limit(0), folder("none")) == 0


def test_older_files_read_under_the_newest_schema(spark, folder):
    table = folder("audit")
    old = spark.createDataFrame(
        [("2026-03-12T00:00:00", "old", "s", False, 0.9)], schemas.AUDIT_RECORD_V0
    )
    append_to_table(old, table, schemas.AUDIT_RECORD_V0)
    commit_landing(spark.createDataFrame([record(1)], schemas.CLINICAL_RECORD), table)
    back = scan_audit_table(spark, table)
    assert back.schema.names == [*schemas.AUDIT_RECORD.names, "event_date"]
    assert rows_of(back.select("patient_id", "risk_score")) == [("PAT-1", 0.0), (None, 0.9)]
    assert set(schemas.AUDIT_RECORD.names) <= set(scan_any_columns(spark, table).columns)


def test_damaged_files_raise_unless_told_otherwise(spark, folder):
    table = folder("audit")
    commit_landing(spark.createDataFrame([record(1)], schemas.CLINICAL_RECORD), table)
    partition = next(Path(table).glob("event_date=*/ingest_batch=*"))
    (partition / "part-damaged.parquet").write_bytes(b"PAR1 not really")
    with pytest.raises(Exception, match="(?i)parquet"):
        scan_audit_table(spark, table).collect()
    assert scan_audit_table(spark, table, skip_corrupt=True).count() == 1


def test_a_batch_written_twice_counts_once(spark, folder):
    table = folder("audit")
    rows = spark.createDataFrame([record(i) for i in range(9)], schemas.CLINICAL_RECORD)
    for batch in ("b-0", "b-0", "b-1"):
        write_batch(rows, table, batch, schemas.AUDIT_RECORD)
    assert scan_audit_table(spark, table).count() == 18


def test_replace_partitions_leaves_the_others(spark, folder):
    table = folder("audit")
    commit_landing(
        spark.createDataFrame([record(i) for i in range(9)], schemas.CLINICAL_RECORD), table
    )
    rows = scan_audit_table(spark, table, keep_batch=True)
    one_day = rows.filter("event_date = '2026-03-02'").withColumn("status", F.lit("dispensed"))
    replace_partitions(spark, one_day, table)
    counts = scan_audit_table(spark, table).groupBy("event_date", "status").count()
    assert [(str(d), s, n) for d, s, n in rows_of(counts)] == [
        ("2026-03-01", "pending_pharmacy", 3),
        ("2026-03-02", "dispensed", 3),
        ("2026-03-03", "pending_pharmacy", 3),
    ]


# -- streams ------------------------------------------------------------------------------


def test_ingest_takes_each_document_once(spark, landing, folder):
    table, checkpoint = folder("audit"), folder("checkpoint")

    def run():
        ingest_folder(spark, str(landing), table, checkpoint, "document", files_per_batch=2).awaitTermination()
        return scan_audit_table(spark, table).count()

    for i in range(5):
        put(landing, f"{i}.json", record(i))
    put(landing, "empty.json", {})
    put(landing, "list.json", [record(10), record(11)])
    (landing / "lab_reports").mkdir()
    put(landing / "lab_reports", "r.json", record(7))
    assert run() == 7
    assert run() == 7
    put(landing, "late.json", record(12))
    assert run() == 8
    # The newest batch, committed once more, as after a crash before its log entry.
    commits = sorted(Path(checkpoint, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    crc = commits[-1].parent / f".{commits[-1].name}.crc"
    commits[-1].unlink()
    crc.unlink(missing_ok=True)
    assert run() == 8


def test_an_empty_checkpoint_never_overwrites(spark, landing, folder):
    table = folder("audit")
    for i in range(2):
        put(landing, f"{i}.json", record(i))
        ingest_folder(spark, str(landing), table, folder("checkpoint"), "document").awaitTermination()
    assert scan_audit_table(spark, table).count() == 3


def test_ingest_takes_old_files(spark, landing, folder):
    table, checkpoint = folder("audit"), folder("checkpoint")
    put(landing, "new.json", record(1))
    ingest_folder(spark, str(landing), table, checkpoint, "document").awaitTermination()
    put(landing, "old.json", record(2))
    long_ago = os.path.getmtime(landing / "new.json") - 30 * 86400
    os.utime(landing / "old.json", (long_ago, long_ago))
    ingest_folder(spark, str(landing), table, checkpoint, "document").awaitTermination()
    assert {r.patient_id for r in scan_audit_table(spark, table).collect()} == {"PAT-1", "PAT-2"}


def test_ingest_sets_damaged_documents_aside(spark, landing, folder):
    table, checkpoint = folder("audit"), folder("checkpoint")
    (landing / "a.json").write_text(json.dumps(record(1)) + '\n{"patient_id": "cut\n')
    for bad in (1, 0):
        query = ingest_folder(spark, str(landing), table, checkpoint)
        query.awaitTermination()
        assert (committed_rows(query), quarantined_rows(query)) == (bad, bad)
    row = spark.read.parquet(quarantine_of(table)).first()
    assert row.document == '{"patient_id": "cut' and row.file_path.endswith("a.json")
    # Read as lines, documents over several lines are set aside.
    put(landing, "pretty.json", record(2))
    query = ingest_folder(spark, str(landing), table, checkpoint, "lines")
    query.awaitTermination()
    assert committed_rows(query) == 0 and quarantined_rows(query) > 0


def test_ingest_counts_every_batch(spark, landing, folder, conf):
    conf(**{"spark__sql__streaming__numRecentProgressUpdates": "2"})
    for i in range(5):
        put(landing, f"{i}.json", record(i))
    query = ingest_folder(
        spark, str(landing), folder("audit"), folder("checkpoint"), "document", files_per_batch=1
    )
    query.awaitTermination()
    assert len(query.recentProgress) <= 2 and committed_rows(query) == 5


def test_a_range_of_days_reads_their_partitions_only(spark, folder):
    table = folder("audit")
    rows = [record(i) for i in range(9)] + [record(20, timestamp="junk")]
    append_to_table(spark.createDataFrame(rows, schemas.CLINICAL_RECORD), table)
    some = scan_audit_table(spark, table, since="2026-03-02", until="2026-03-02")
    assert {r.patient_id for r in some.collect()} == {"PAT-1", "PAT-4", "PAT-7"}
    plan = some._jdf.queryExecution().toString()
    filters = plan[plan.rindex("PartitionFilters") :]
    assert ">= 2026-03-02" in filters and "<= 2026-03-02" in filters
    assert scan_audit_table(spark, table, until="1970-01-01").count() == 1


def test_rows_of_a_file_lie_by_patient(spark, folder):
    table = folder("audit")
    rows = [record(i, timestamp="2026-03-01T10:00:00") for i in (5, 3, 9, 1, 7)]
    append_to_table(spark.createDataFrame(rows, schemas.CLINICAL_RECORD).coalesce(1), table)
    found = [r.patient_id for r in scan_audit_table(spark, table).collect()]
    assert found == sorted(found) and len(found) == 5


def test_job_lists_open_requests(spark, folder):
    requests, reports, out = folder("requests"), folder("reports"), folder("out")
    asked = [(f"Q{i}", "P", "CBC", "D", "2026-01-01", "Pending") for i in range(3)]
    land(spark.createDataFrame(asked, schemas.LAB_REQUEST), requests)
    land(spark.createDataFrame([{"report_id": "R", "request_id": "Q1"}], schemas.LAB_REPORT), reports)
    jobs.run(spark, ["requests", requests, reports, out])
    assert sorted(r.request_id for r in spark.read.json(out).collect()) == ["Q0", "Q2"]


def test_a_rewrite_leaves_no_copy_behind(spark, folder, monkeypatch):
    from wardbook.sinks import table as sink

    table, asides = folder("audit"), []
    rows = spark.createDataFrame([record(i) for i in range(4)], schemas.CLINICAL_RECORD)
    append_to_table(rows, table)
    monkeypatch.setattr(sink, "shared_folder", lambda s, label: asides.append(folder(label)) or asides[-1])
    replace_partitions(spark, scan_audit_table(spark, table, keep_batch=True), table)
    assert len(asides) == 1 and not os.path.exists(asides[0])
    assert scan_audit_table(spark, table).count() == 4


def test_landed_records_are_read_by_default(spark, folder):
    path = folder("landed")
    land(spark.createDataFrame([record(i) for i in range(20)], schemas.CLINICAL_RECORD), path)
    assert documents.scan_clinical(spark, path).count() == 20


def test_a_field_of_another_type_damages_no_report(spark, landing):
    for i, tests in enumerate(([{"test_name": "a"}], {"test_name": "b"}, "c")):
        put(landing, f"{i}.json", {"report_id": f"R{i}", "lab_tests": tests})
    put(landing, "cut.json", '{"report_id": "R9')
    rows = documents.scan_lab_reports(spark, str(landing), "document").collect()
    assert sorted(r.report_id for r in rows) == ["R0", "R1", "R2"]


def test_status_events_lie_under_the_day_they_happened(spark, folder):
    events, log = folder("events"), folder("log")
    land(spark.createDataFrame([("P", None, None, "dispensed", "2026-04-01T00:00:00")], EVENTS), events)
    log_status_events(spark, events, log, folder("checkpoint")).awaitTermination()
    assert os.path.isdir(f"{log}/event_date=2026-04-01")


def test_errors_in_a_batch_reach_the_caller(spark, landing, folder):
    put(landing, "a.json", record(1))

    def fail(batch, name):
        raise RuntimeError("sink is down")

    stream = spark.readStream.schema(schemas.CLINICAL_RECORD).json(str(landing))
    query = start_batches(stream, folder("checkpoint"), fail)
    with pytest.raises(Exception, match="sink is down"):
        query.awaitTermination()


def test_status_stream_folds_into_the_log_and_the_table(spark, folder):
    rows, log = random_status_case(5)
    table, events, events_log = folder("audit"), folder("events"), folder("log")
    checkpoint = folder("checkpoint")
    commit_landing(spark.createDataFrame(rows, STATES), table)
    half = len(log) // 2
    for part in (log[half:], log[:half]):  # the older events come last
        land(spark.createDataFrame([tuple(e.values()) for e in part], EVENTS), events)
        log_status_events(spark, events, events_log, checkpoint, table).awaitTermination()
    assert status_log(spark, events_log).count() == len(log)
    names = ["patient_id", "raw_transcript", "timestamp", "status", "pharmacy_status"]
    wanted = _fold_by_hand(rows, log)
    assert rows_of(scan_audit_table(spark, table).select(*names)) == wanted
    fold_into_table(spark, table, status_log(spark, events_log))
    assert rows_of(scan_audit_table(spark, table).select(*names)) == wanted


def test_jobs(spark, landing, folder, capsys):
    table, checkpoint, out = folder("audit"), folder("checkpoint"), folder("out")
    put(landing, "a.json", [record(i) for i in range(4)])
    put(landing, "b.json", {})
    ingest = ["ingest", str(landing), table, checkpoint, "--layout", "document"]
    for _ in range(2):
        jobs.run(spark, ingest)
    assert capsys.readouterr().out == "4 records committed\n0 records committed\n"
    events = folder("events")
    dispensed = [("PAT-1", None, None, "dispensed", "2026-04-01T00:00:00")]
    land(spark.createDataFrame(dispensed, EVENTS), events)
    log = folder("log")
    jobs.run(spark, ["status", events, log, folder("checkpoint"), "--table", table])
    where = ["--layout", "document", "--log", log, "--status"]
    jobs.run(spark, ["records", str(landing), table, out, *where, "pending_pharmacy"])
    seen = spark.read.json(out)
    assert seen.count() == 3 and "event_date" not in seen.columns
    served = folder("out")
    jobs.run(spark, ["records", str(landing), table, served, *where, "dispensed"])
    # No record stands in two queues, though the landing documents are untouched.
    assert [r.patient_id for r in spark.read.json(served).collect()] == ["PAT-1"]
    assert "PAT-1" not in {r.patient_id for r in seen.collect()}
    assert scan_audit_table(spark, table).filter("status = 'dispensed'").count() == 1


# -- shared folder -----------------------------------------------------------------------------


class _Session:
    """As much of a session as ``shared_folder`` asks."""

    def __init__(self, master, directory):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = {} if directory is None else {"spark.checkpoint.dir": directory}


def test_shared_folder_follows_the_session(spark):
    on_cluster = _Session("yarn", "hdfs://shared/place")
    first, second = shared_folder(on_cluster, "x"), shared_folder(on_cluster, "x")
    assert first.startswith("hdfs://shared/place/x-") and first != second
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark, "x").startswith(named)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Session("yarn", None), "x")
    assert shared_folder(_Session("local[2]", None), "x")
