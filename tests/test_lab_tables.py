"""Lab documents as tables."""

from __future__ import annotations

import gzip
import json
import re
from pathlib import Path

from conftest import TESTDATA, rows_of
from pyspark.sql import functions as F
from test_folders import landing, put  # noqa: F401 - landing is a fixture

from catalog import folder_queries
from catalog.registry import QUERIES
from wardbook import jobs, schemas
from wardbook.plans.lab_loop import reports_of, request_queue
from wardbook.sinks.landing import land
from wardbook.sinks.table import write_batch
from wardbook.sources.documents import scan_lab_reports
from wardbook.sources.inventory import folder_files
from wardbook.streaming.ingest import committed_rows, quarantine_of, quarantined_rows
from wardbook.streaming.lab import LOOKUPS, ingest_lab, scan_lab


def report(number, patient="P1", date="2026-03-01", request=None):
    return {"report_id": f"R{number}", "patient_id": patient, "date": date, "request_id": request}


def test_completion_outlives_the_reports_folder(spark, landing, folder, capsys):  # noqa: F811
    requests, reports, checkpoint = folder("requests"), folder("reports"), folder("checkpoint")
    asked = Path(folder("asked"))
    asked.mkdir()
    for i in range(4):
        put(asked, f"{i}.json", {"request_id": f"Q{i}", "patient_id": "P1", "date": "2026-03-01", "status": "Pending"})
    jobs.run(spark, ["lab", "requests", str(asked), requests, folder("checkpoint")])
    seen = []
    for number in (1, 3):
        put(landing, f"{number}.json", report(number, request=f"Q{number}"))
        jobs.run(spark, ["lab", "reports", str(landing), reports, checkpoint])
        (landing / f"{number}.json").unlink()
        out = folder("out")
        jobs.run(spark, ["requests", requests, reports, out, "--tables"])
        seen.append(sorted(r.request_id for r in spark.read.json(out).collect()))
    assert seen == [["Q0", "Q2", "Q3"], ["Q0", "Q2"]]
    assert capsys.readouterr().out == "4 requests committed\n1 reports committed\n1 reports committed\n"
    out = folder("out")
    jobs.run(spark, ["patient", reports, "P1", out])
    assert sorted(r.report_id for r in spark.read.json(out).collect()) == ["R1", "R3"]


def test_damaged_and_empty_reports(spark, landing, folder):  # noqa: F811
    table, checkpoint = folder("reports"), folder("checkpoint")
    put(landing, "a.json", [report(1), report(2, date=None)])
    put(landing, "b.json", "\n".join([json.dumps(report(3)), "{}", '{"report_id": "R']))
    for new in (3, 0):
        query = ingest_lab(spark, "reports", str(landing), table, checkpoint)
        query.awaitTermination()
        assert (committed_rows(query), quarantined_rows(query)) == (new, min(new, 1))
    rows = scan_lab(spark, "reports", table)
    assert rows.columns == schemas.LAB_REPORT.names
    assert [r.report_id for r in reports_of(rows, "P1").collect()] == ["R1", "R3", "R2"]
    assert scan_lab(spark, "reports", table, since="2026-03-01").count() == 2
    assert scan_lab(spark, "reports", table, since="2026-03-02").count() == 0
    assert scan_lab(spark, "reports", table, until="2026-03-01").count() == 2
    assert spark.read.parquet(quarantine_of(table)).count() == 1


def scanned_rows(df):
    """Rows that the scan of a finished query gave to its filter."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    while leaf.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ResultQueryStageExec", "ShuffleQueryStageExec"):
        name = leaf.getClass().getSimpleName()
        leaf = (leaf.executedPlan() if name.startswith("Adaptive") else leaf.plan()).collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_a_lookup_skips_row_groups(spark, folder, conf):
    table = folder("reports")
    rows = spark.range(60_000).select(
        F.concat(F.lit("R"), F.col("id")).alias("report_id"),
        F.concat(F.lit("P"), F.col("id") % 3000).alias("patient_id"),
        F.lit("2026-03-01").alias("date"),
        F.concat(F.lit("Q"), F.hash("id")).alias("request_id"),
    )
    small = {"parquet.block.size": "65536", "parquet.page.size": "8192"}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in small.items():
        hadoop.set(key, value)
    try:
        write_batch(rows, table, "b-0", schemas.LAB_REPORT, LOOKUPS)
    finally:
        for key in small:
            hadoop.unset(key)
    found = scan_lab(spark, "reports", table)
    mine = found.filter("patient_id = 'P77'").select("report_id", "patient_id")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(patient_id,P77\)", mine._jdf.queryExecution().executedPlan().toString())
    assert mine.count() == 20
    # Rows lie by patient, so most groups are out of range; requests are told by their filter.
    assert scanned_rows(mine) < 20_000
    wanted = rows.filter("report_id = 'R4321'").first().request_id
    one = found.filter(F.col("request_id") == wanted).select("report_id", "request_id")
    assert [r.report_id for r in one.collect()] == ["R4321"]
    assert scanned_rows(one) < 20_000
    assert rows_of(request_queue(spark.createDataFrame([], schemas.LAB_REQUEST), found)) == []


def test_compressed_files_land_and_are_found(spark, landing, folder):  # noqa: F811
    rows = spark.range(3000).selectExpr(
        "concat('R', id) report_id", "concat('P', id % 7) patient_id", "'Blood' report_type", "'2026-03-01' date",
        "string(null) file_path", "array(struct('Iron' test_name, string(id) value, '1' normal_range, 'HIGH' status)) lab_tests",
        "string(null) request_id",
    )
    path, plain = str(landing), folder("plain")
    land(rows.coalesce(1), path, compressed=True)
    land(rows.coalesce(1), plain)
    size = {p: sum(f.stat().st_size for f in Path(p).glob("*.json*")) for p in (path, plain)}
    assert size[path] < size[plain] / 5
    put(landing, "more.json", report(5000))
    (landing / "whole.json.gz").write_bytes(gzip.compress(json.dumps(report(5001), indent=2).encode()))
    (landing / "bad.json.gz").write_bytes(gzip.compress(b'{"report_id": "R1\n'))
    (landing / "none.json.gz").write_bytes(b"")
    for layout, found in (("lines", 3000), ("auto", 3002)):
        assert scan_lab_reports(spark, path, layout).where("report_id is not null").count() == found
    files = {r.file_name: (r.records, r.damaged) for r in folder_files(spark, "lab", path, schemas.LAB_REPORT).collect()}
    assert files["bad.json.gz"] == (0, 1) and files["none.json.gz"] == (0, 0) and len(files) == 5
    table = folder("reports")
    ingest_lab(spark, "reports", path, table, folder("checkpoint")).awaitTermination()
    assert scan_lab(spark, "reports", table).count() == 3002


def test_queries_land_compressed_files(spark, conf, monkeypatch):
    seen = []
    monkeypatch.setattr(folder_queries, "land", lambda rows, path, **how: (seen.append(how), land(rows, path, **how)))
    for name in ("land_lab_reports", "completed_for_good", "patient_reports_table"):
        QUERIES[name](spark, str(TESTDATA))
    assert len(seen) == 5 and all(how["compressed"] for how in seen)
