"""What is read and what is not: ledger, touched days, layouts, compaction, kept visits."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_folders import landing, put, record  # noqa: F401 - landing is a fixture
from test_operators import EVENTS, STATES, _fold_by_hand, random_status_case

from wardbook import jobs, schemas
from wardbook.functions.timestamps import parse_timestamp
from wardbook.operators.dedup import last_visits
from wardbook.operators.history import patient_history
from wardbook.plans import recent_visits
from wardbook.plans.commit import commit_landing
from wardbook.plans.records_view import current_records, records_view
from wardbook.plans.status_log import fold_into_table, fold_status, touched_days
from wardbook.sinks import compaction
from wardbook.sinks.landing import land
from wardbook.sinks.table import write_batch
from wardbook.sources import documents
from wardbook.sources.ledger import scan_uncommitted, uncommitted_files
from wardbook.sources.table import scan_audit_table
from wardbook.streaming.ingest import committed_rows, ingest_folder, quarantine_of, quarantined_rows
from wardbook.streaming.queue import log_status_events, status_log


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.CLINICAL_RECORD)


def names(paths):
    return sorted(p.rsplit("/", 1)[1] for p in paths)


# -- ledger -------------------------------------------------------------------------------


def test_committed_files_are_not_opened_again(spark, landing, folder):  # noqa: F811
    table, checkpoint = folder("audit"), folder("checkpoint")
    put(landing, "a 1.json", [record(1), record(2)])
    put(landing, "silent.json", [record(3), record(4, raw_transcript=None)])
    put(landing, "broken.json", '{"patient_id": "PAT-9')
    put(landing, "none.json", "")
    ingest_folder(spark, str(landing), table, checkpoint).awaitTermination()
    put(landing, "late [2].json", record(5))
    # A document without transcript is in the landing folder alone, so its file is read.
    assert names(uncommitted_files(spark, str(landing), table)) == ["late%20%5B2%5D.json", "silent.json"]
    fresh = scan_uncommitted(spark, str(landing), table, layout="auto")
    assert {r.patient_id for r in fresh.collect()} == {"PAT-3", "PAT-4", "PAT-5"}
    view = current_records(spark, str(landing), table, layout="auto")
    assert names(f for f in view.inputFiles() if f.endswith(".json")) == [
        "late%20%5B2%5D.json", "silent.json",
    ]
    assert {r.patient_id for r in view.collect()} == {f"PAT-{i}" for i in range(1, 6)}
    ingest_folder(spark, str(landing), table, checkpoint).awaitTermination()
    assert names(uncommitted_files(spark, str(landing), table)) == ["silent.json"]
    assert view.count() == current_records(spark, str(landing), table, layout="auto").count() == 5


def test_view_by_ledger_equals_the_view_of_everything(spark, landing, folder):  # noqa: F811
    table, checkpoint = folder("audit"), folder("checkpoint")
    for i in range(12):
        put(landing, f"{i}.json", record(i % 9, timestamp=f"2026-03-0{i % 4 + 1}T10:00:00.{i:06d}"))
        if i == 6:
            ingest_folder(spark, str(landing), table, checkpoint).awaitTermination()
    kept = ["patient_id", "raw_transcript", "timestamp", "status"]
    whole = records_view(documents.scan_clinical(spark, str(landing), "auto"), scan_audit_table(spark, table))
    ours = current_records(spark, str(landing), table, layout="auto")
    assert rows_of(ours.select(*kept)) == rows_of(whole.select(*kept))
    day = current_records(spark, str(landing), table, "auto", since="2026-03-02", until="2026-03-03")
    in_range = whole.filter(F.substring("timestamp", 1, 10).between("2026-03-02", "2026-03-03"))
    assert rows_of(day.select(*kept)) == rows_of(in_range.select(*kept)) != []
    plan = day._jdf.queryExecution().toString()
    assert ">= 2026-03-02" in plan[plan.rindex("PartitionFilters") :]


def test_jobs_take_a_range_and_an_archive(spark, landing, folder, capsys):  # noqa: F811
    table, out, archive = folder("audit"), folder("out"), folder("archive")
    for i in range(1, 4):
        put(landing, f"{i}.json", record(i))
    ingest = ["ingest", str(landing), table, folder("checkpoint"), "--archive", archive]
    jobs.run(spark, [*ingest, "--visits", folder("visits")])
    jobs.run(spark, ["records", str(landing), table, out, "--since", "2026-03-02", "--until", "2026-03-02"])
    assert [r.patient_id for r in spark.read.json(out).collect()] == ["PAT-1"]
    jobs.run(spark, ["compact", table])
    assert capsys.readouterr().out.startswith("3 records committed\n")


# -- touched days -------------------------------------------------------------------------


def _table(spark, folder, days=6):
    table = folder("audit")
    rows = [
        record(i, patient_id=f"P{i % 5}", raw_transcript=f"talk {i}", timestamp=f"2026-03-{i % days + 1:02d}T10:00:00")
        for i in range(30)
    ]
    commit_landing(frame(spark, rows), table)
    return table


def _events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS)


def test_touched_days(spark, folder):
    table = _table(spark, folder)
    late = "2026-04-01T00:00:00"

    def days(*rows):
        return [d.day for d in touched_days(spark, table, _events(spark, *rows))]

    assert days((None, "2026-03-03 10:00", "talk 2", "s", late)) == [3]
    # A token without a day may fit on any, and so does another zone's day.
    assert days((None, "10:00:00", "talk 2", "s", late)) == [3]
    assert days((None, "2026-03-02T23:00:00-11:00", "talk 2", "s", late)) == [3]
    assert days((None, "2026-03-03", "no such talk", "s", late)) == []
    assert days(("P1", None, None, "dispensed", late)) == [1, 2, 3, 4, 5, 6]
    assert days(("nobody", None, None, "dispensed", late)) == []


def test_a_fold_reads_the_touched_days_alone(spark, folder, monkeypatch):
    from wardbook.plans import status_log as plans

    table, read = _table(spark, folder), []
    scan = plans.scan_audit_table
    events = _events(spark, (None, "2026-03-03", "talk 2", "seen", "2026-04-01T00:00:00"))

    def watched(*args, **options):
        rows = scan(*args, **options)
        read.append(rows)
        return rows

    monkeypatch.setattr(plans, "scan_audit_table", watched)
    days = touched_days(spark, table, events)
    untouched = {p: p.stat().st_mtime_ns for p in Path(table).glob("event_date=*/*/*.parquet") if "03-03" not in str(p)}
    # Damage every other day's files: nobody looks into them.
    for path in untouched:
        path.chmod(0o600)
        path.write_bytes(b"PAR1")
    fold_into_table(spark, table, events, days)
    monkeypatch.undo()
    found = scan_audit_table(spark, table, since="2026-03-03", until="2026-03-03")
    assert {r.status for r in found.filter("raw_transcript = 'talk 2'").collect()} == {"seen"}
    assert found.count() == 5 and len(read) == 2


def test_keys_are_read_without_the_records(spark, folder):
    table = _table(spark, folder)
    keys = scan_audit_table(spark, table, keep_digest=True).select("event_date", "transcript_digest")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<transcript_digest:string>", plan)
    row = scan_audit_table(spark, table, keep_digest=True).first()
    assert row.transcript_digest is not None
    assert "transcript_digest" not in scan_audit_table(spark, table).columns


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folding_batch_by_batch_equals_folding_at_once(spark, folder, seed):
    rows, log = random_status_case(seed)
    table, events, events_log = folder("audit"), folder("events"), folder("log")
    commit_landing(spark.createDataFrame(rows, STATES), table)
    checkpoint = folder("checkpoint")
    third = max(1, len(log) // 3)
    for part in (log[third:][:third], log[2 * third :], log[:third]):
        if part:
            land(spark.createDataFrame([tuple(e.values()) for e in part], EVENTS), events)
            log_status_events(spark, events, events_log, checkpoint, table).awaitTermination()
    kept = ["patient_id", "raw_transcript", "timestamp", "status", "pharmacy_status"]
    assert rows_of(scan_audit_table(spark, table).select(*kept)) == _fold_by_hand(rows, log)
    logged = status_log(spark, events_log)
    assert "transcript_digest" in logged.columns and logged.count() == len(log)


def test_old_files_without_a_digest_are_folded_too(spark, folder):
    table = folder("audit")
    rows = frame(spark, [record(1), record(2)])
    write_batch(rows, table, "b-0", schemas.AUDIT_RECORD)
    old = spark.read.parquet(table).drop("transcript_digest")
    bare = folder("bare")
    old.write.partitionBy("event_date", "ingest_batch").parquet(bare)
    text = record(1)["raw_transcript"]
    events = _events(spark, (None, "2026-03-02", text, "seen", "2026-04-01T00:00:00"))
    for path in (table, bare):
        fold_into_table(spark, path, events, touched_days(spark, path, events))
        found = scan_audit_table(spark, path).select("patient_id", "status")
        assert rows_of(found) == [("PAT-1", "seen"), ("PAT-2", "pending_pharmacy")]
    folded = fold_status(rows, events)
    assert rows_of(folded.select("patient_id", "status"))[0] == ("PAT-1", "seen")


# -- layouts ------------------------------------------------------------------------------


def _mixed(landing):  # noqa: F811
    put(landing, "pretty.json", record(1))
    put(landing, "array.json", [record(2), record(3)])
    compact_array = "[\n" + ",\n".join(json.dumps(record(i)) for i in (4, 5)) + "\n]"
    put(landing, "rows of an array.json", compact_array)
    put(landing, "lines.json", "\n".join(json.dumps(record(i)) for i in (6, 7, 8)))
    put(landing, "damaged line.json", "{cut\n" + json.dumps(record(9)))
    put(landing, "two pretty.json", json.dumps(record(10), indent=2) + "\n" + json.dumps(record(11), indent=2))
    put(landing, "one line.json", json.dumps(record(12)) + "\n\n")
    put(landing, "cut.json", json.dumps(record(13), indent=2)[:-20])
    put(landing, "text.json", "no json\nat all")
    put(landing, "blank.json", "\n \n")


def test_each_file_has_a_layout_of_its_own(spark, landing, folder):  # noqa: F811
    _mixed(landing)
    whole = {f"PAT-{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12)}
    for layout in ("auto", "document"):
        rows = documents.readable(spark, str(landing), schemas.CLINICAL_RECORD, layout)
        assert sorted(r.patient_id for r in rows.collect() if r.patient_id) == sorted(whole)
    bad = documents.quarantine(spark, str(landing), schemas.CLINICAL_RECORD, "auto")
    texts = {}
    for row in bad.collect():
        texts.setdefault(names([row.file_path])[0], []).append(row.document)
    assert set(texts) == {"damaged%20line.json", "two%20pretty.json", "cut.json", "text.json"}
    assert texts["damaged%20line.json"] == ["{cut"] and sorted(texts["text.json"]) == ["at all", "no json"]
    # Nothing of an unreadable file is lost: all its lines are there.
    assert len(texts["two%20pretty.json"]) == json.dumps([record(10), record(11)], indent=2).count("\n") - 1
    table = folder("audit")
    query = ingest_folder(spark, str(landing), table, folder("checkpoint"), files_per_batch=3)
    query.awaitTermination()
    assert {r.patient_id for r in scan_audit_table(spark, table).collect()} == whole
    assert committed_rows(query) == len(whole) and quarantined_rows(query) == bad.count()
    assert spark.read.parquet(quarantine_of(table)).count() == bad.count()


def test_whole_documents_are_not_parsed_as_lines_again(spark, landing):  # noqa: F811
    put(landing, "pretty.json", record(1))
    put(landing, "lines.json", json.dumps(record(2)))
    rows = documents.scan_clinical(spark, str(landing), "auto")
    assert rows.count() == 2
    keys = documents.scan_union_of_keys(spark, str(landing), "auto")
    assert keys.count() == 2 and "patient_id" in keys.columns


# -- compaction ---------------------------------------------------------------------------


def _batches(spark, table, count, days=4):
    """``count`` batches of one stream, written without a job for each."""
    ids = spark.range(count).select(
        F.concat(F.lit("PAT-"), F.col("id")).alias("patient_id"),
        F.concat(F.lit("talk "), F.col("id")).alias("raw_transcript"),
        F.concat(F.lit("2026-03-0"), F.col("id") % days + 1, F.lit("T10:00:00")).alias("timestamp"),
        F.lit("pending_pharmacy").alias("status"),
        F.to_date(F.concat(F.lit("2026-03-0"), F.col("id") % days + 1)).alias("event_date"),
        F.concat(F.lit("query-"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("ingest_batch"),
    )
    ids.repartition(1).write.partitionBy("event_date", "ingest_batch").parquet(table)


def _files(table):
    return list(Path(table).glob("event_date=*/ingest_batch=*/*.parquet"))


def test_many_batches_become_one_file_a_day(spark, folder):
    table = folder("audit")
    _batches(spark, table, 500)
    before = rows_of(scan_audit_table(spark, table))
    assert len(_files(table)) == 500
    assert compaction.compact(spark, table, schema=schemas.AUDIT_TABLE) == 499
    # The newest batch may be written again by its stream and stays as it is.
    assert len(_files(table)) == 4 + 1
    assert rows_of(scan_audit_table(spark, table)) == before
    assert compaction.compact(spark, table, schema=schemas.AUDIT_TABLE) == 0
    assert not list(Path(table).glob("_compaction/*"))


def test_large_folders_stay(spark, folder):
    table = folder("audit")
    _batches(spark, table, 12, days=2)
    assert compaction.compact(spark, table, small=10, schema=schemas.AUDIT_TABLE) == 0
    assert len(_files(table)) == 12


@pytest.mark.parametrize("crash", ["write", "plan", "swap", "delete"])
def test_a_cut_short_compaction_loses_nothing(spark, folder, monkeypatch, crash):
    table = folder("audit")
    _batches(spark, table, 40)
    before = rows_of(scan_audit_table(spark, table))
    swap, delete = compaction._swap, compaction.Folder.delete
    calls = []

    def fail(*_):
        raise RuntimeError("lost")

    def fail_after_three(self):
        calls.append(1)
        if len(calls) > 3:
            raise RuntimeError("lost")
        delete(self)

    if crash == "write":
        with pytest.raises(RuntimeError, match="lost"):
            compaction.compact(spark, table, schema=schemas.AUDIT_TABLE, rewrite=fail)
    elif crash == "plan":
        monkeypatch.setattr(compaction, "_swap", fail)
        with pytest.raises(RuntimeError, match="lost"):
            compaction.compact(spark, table, schema=schemas.AUDIT_TABLE)
        # As if the run had ended before its list of folders was whole.
        for done in Path(table).glob("_compaction/*/plan/_SUCCESS"):
            done.unlink()
    elif crash == "swap":
        monkeypatch.setattr(compaction, "_swap", fail)
        with pytest.raises(RuntimeError, match="lost"):
            compaction.compact(spark, table, schema=schemas.AUDIT_TABLE)
    else:
        monkeypatch.setattr(compaction.Folder, "delete", fail_after_three)
        with pytest.raises(RuntimeError, match="lost"):
            compaction.compact(spark, table, schema=schemas.AUDIT_TABLE)
        # Rows may stand twice now; the record view shows each once.
        seen = records_view(scan_audit_table(spark, table))
        assert seen.count() == 40
    monkeypatch.setattr(compaction, "_swap", swap)
    monkeypatch.setattr(compaction.Folder, "delete", delete)
    if crash != "delete":
        assert rows_of(scan_audit_table(spark, table)) == before
    compaction.compact(spark, table, schema=schemas.AUDIT_TABLE)
    assert rows_of(scan_audit_table(spark, table)) == before and len(_files(table)) == 5


# -- kept visits ----------------------------------------------------------------------------


def test_kept_visits_equal_the_last_visits_of_all_records(spark, folder):
    visits, rows = folder("visits"), []
    for batch in range(3):
        own = [
            record(i, patient_id=f"P{i % 7}" if i % 9 else None, diagnosis=None if i % 4 == 0 else f"d{i}",
                   timestamp=None if i == 17 else f"2026-0{(i * 7) % 5 + 1}-1{i % 3}T10:00:00")
            for i in range(batch * 40, batch * 40 + 40)
        ]
        rows += own
        for _ in range(2):  # a replayed batch counts once
            recent_visits.merge_visits(frame(spark, own), visits, f"query-{batch:012d}")
        everything = frame(spark, rows)
        assert rows_of(recent_visits.kept_history(spark, visits)) == rows_of(patient_history(everything))
        if batch == 1:
            recent_visits.compact_visits(spark, visits)
    some = spark.createDataFrame([("P1",), ("P2",), ("P1",)], "patient_id string")
    assert recent_visits.kept_history(spark, visits, some).count() == 2
    newest = last_visits(everything, "patient_id", parse_timestamp(F.col("timestamp")), [F.col("raw_transcript")], 3)
    assert recent_visits.visits_in(spark, visits).count() <= 3 * newest.count()
    assert all(visits in f for f in recent_visits.kept_history(spark, visits).inputFiles())
