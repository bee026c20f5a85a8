"""Physical plans: pushed filters, pre-aggregation, skew handling, no Python."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest
from conftest import TESTDATA, plan_of, rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from wardbook.operators import dedup, folds, history, keyed
from wardbook.plans.commit import commit_landing
from wardbook.plans.records_view import records_view
from wardbook.schemas import CLINICAL_RECORD
from wardbook.sources.table import scan_audit_table

CALLS_A_MODEL = {"enrich_stub", "lab_analysis_stub", "model_answers"}
WRITES_FOLDERS = {
    name
    for name, run in entry_points.queries().items()
    if run.__closure__ and any(
        getattr(cell.cell_contents, "__module__", "") == "catalog.folder_queries"
        for cell in run.__closure__
    )
}


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - CALLS_A_MODEL - WRITES_FOLDERS))
def test_queries_stay_in_the_jvm_and_join_by_key(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, str(TESTDATA)))
    for operator in ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


@pytest.fixture
def table(spark, folder):
    path = folder("audit")
    rows = spark.range(300).select(
        F.concat(F.lit("p"), F.col("id") % 7).alias("patient_id"),
        F.concat(F.lit("text "), F.col("id") % 50).alias("raw_transcript"),
        F.concat(F.lit("2026-03-0"), F.col("id") % 5 + 1, F.lit("T10:00:00")).alias("timestamp"),
        F.lit("pending_pharmacy").alias("status"),
    )
    commit_landing(rows, path)
    return scan_audit_table(spark, path)


def test_view_filters_reach_both_scans(table):
    view = records_view(table, table, patient_id="p1", status="pending_pharmacy")
    plan = plan_of(view)
    assert len(re.findall(r"PushedFilters: \[[^\]]*EqualTo\(patient_id,p1\)", plan)) == 2
    assert len(re.findall(r"PushedFilters: \[[^\]]*EqualTo\(status,pending_pharmacy\)", plan)) == 2
    assert plan.count("WindowGroupLimit") >= 2


def test_a_day_prunes_partitions_and_columns(table):
    day = table.filter(F.col("event_date") == "2026-03-02").select("patient_id", "event_date")
    plan = plan_of(day)
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan)
    assert "ReadSchema: struct<patient_id:string>" in plan


def test_last_visits_are_cut_before_the_shuffle(table):
    last = dedup.last_visits(table, "patient_id", F.col("timestamp"), [F.col("raw_transcript")], 3)
    plan = plan_of(last)
    below = plan[plan.index("Exchange hashpartitioning(patient_id") :]
    assert "WindowGroupLimit" in below


def test_history_shuffles_once(table):
    plan = plan_of(history.patient_history(table))
    assert plan.count("Exchange hashpartitioning") == 1


def test_latest_rows_are_aggregated_before_the_shuffle(table):
    plan = plan_of(keyed.last_per_key(table.drop("symptoms"), ["patient_id"], ["timestamp"]))
    assert "partial_max_by" in plan[plan.index("Exchange hashpartitioning") :]


# -- one key holds a third of the rows -----------------------------------------------------

ROWS = 120_000


@pytest.fixture
def hot(spark, conf, folder):
    """Records of which one patient, one transcript and one time hold a third."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__shuffle__partitions="16",
    )
    path = folder("hot")
    third = F.col("id") % 3 == 0
    number = F.col("id").cast("string")
    spark.range(0, ROWS, 1, 12).select(
        F.when(third, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5000)).alias("patient_id"),
        F.when(third, "Yes.").otherwise(F.sha2(number, 256)).alias("raw_transcript"),
        F.when(third, "2026-03-01T10:00:00").otherwise(
            F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss")
        ).alias("timestamp"),
        F.lit("pending_pharmacy").alias("status"),
        F.sha2(F.concat(number, F.lit("x")), 256).alias("dosage"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_dispense_splits_the_hot_patient(spark, hot):
    events = spark.createDataFrame([("hot",), ("p17",)], "patient_id string")
    # Many events, so that the side that names the patients is shuffled as well.
    events = events.unionByName(spark.range(4000).select(F.concat(F.lit("q"), "id").alias("patient_id")))
    done = keyed.dispense(hot, events)
    assert done.filter("status = 'dispensed'").count() == ROWS // 3 + hot.filter("patient_id = 'p17'").count()
    done.write.format("noop").mode("overwrite").save()
    done.collect()
    assert "SortMergeJoin(skew=true)" in plan_of(done)


def test_complete_requests_splits_the_hot_request(spark, hot):
    requests = hot.withColumnRenamed("patient_id", "request_id").select("request_id", "status", "dosage")
    reports = spark.range(8000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("request_id")
    )
    done = keyed.complete_requests(requests, reports)
    assert len(done.filter("status = 'Completed' and request_id = 'hot'").collect()) == ROWS // 3
    done.collect()
    assert "SortMergeJoin(skew=true)" in plan_of(done)


def test_update_status_of_a_hot_transcript(spark, hot):
    events = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "Yes.").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("raw_transcript"),
        F.lit("2026-03-01 09:00:00").alias("timestamp"),
        F.format_string("n%05d", "id").alias("status"),
        F.col("id").alias("n"),
    )
    done = keyed.update_status(hot, events, ["n"])
    counts = dict(rows_of(done.groupBy("status").count()))
    assert counts == {"n02997": ROWS // 3, "pending_pharmacy": ROWS - ROWS // 3}


def test_dedup_of_a_hot_group_of_copies(hot):
    view = records_view(hot)
    assert view.filter("raw_transcript = 'Yes.'").count() == 1
    assert view.count() == ROWS - ROWS // 3 + 1


def test_ordering_spreads_a_hot_time(hot):
    ordered = dedup.newest_first(hot, F.col("timestamp"), [F.col("dosage")])
    sizes = [r[0] for r in ordered.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < ROWS // 3


def test_history_of_wanted_patients_splits_the_hot_one(spark, hot):
    rows = hot.selectExpr("*", "dosage as diagnosis", "dosage as medication", "array(status) as symptoms")
    wanted = spark.range(3000).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("patient_id"))
    last = history.patient_history(rows, wanted)
    assert len(last.collect()) == 3000
    plan = plan_of(last)
    assert "SortMergeJoin(skew=true)" in plan
    after_join = plan[: plan.index("SortMergeJoin(skew=true)")]
    assert after_join.count("WindowGroupLimit") == 2  # cut again before the next shuffle


def test_history_of_a_hot_patient(hot):
    rows = hot.selectExpr("*", "dosage as diagnosis", "dosage as medication", "array(status) as symptoms")
    last = history.patient_history(rows, indented=False).filter("patient_id = 'hot'").first()
    assert last["history"].count('"date"') == 3


def test_a_long_consultation_is_folded_in_stretches(spark):
    lines = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") < 10_000, "long").otherwise(F.concat(F.lit("c"), F.col("id") % 997)).alias("consult_id"),
        F.col("id").alias("turn"),
        F.concat(F.lit("Doctor: "), F.col("id")).alias("line"),
    )
    segments = folds.conversation_segments(lines, segment_turns=500)
    assert segments.filter("consult_id = 'long'").count() == 20
    text = folds.fold_conversations(lines, segment_turns=500).filter("consult_id = 'long'").first()[1]
    assert text == "\n".join(f"Doctor: {i}" for i in range(10_000))


def test_a_hot_day_is_written_by_many_tasks(spark, hot, folder):
    path = folder("audit")
    rows = hot.withColumn("timestamp", F.lit("2026-03-01T10:00:00")).select(
        *(c for c in hot.columns if c in CLINICAL_RECORD.names)
    )
    commit_landing(rows, path)
    files = [f for f in os.listdir(next(Path(path).glob("event_date=*/ingest_batch=*"))) if f.endswith(".parquet")]
    assert len(files) >= 3
