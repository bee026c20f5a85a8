from __future__ import annotations

import datetime as dt
import random

from conftest import rows_of
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.transcript import speaker_label, transcript_line
from wardbook.operators import counts, dedup, filters, folds, history, keyed
from wardbook.plans import status_log
from wardbook.plans.lab_loop import reports_of, request_queue
from wardbook.plans.records_view import records_view, register_audits
from wardbook.schemas import CLINICAL_RECORD, STATUS_EVENT
from wardbook.sinks.landing import dispense_events, update_events

SHORT = "patient_id string, raw_transcript string, timestamp string, status string"


def records(spark, rows):
    return spark.createDataFrame(rows, SHORT)


# -- filters ---------------------------------------------------------------------


def test_with_transcript(spark):
    frame = records(spark, [("a", None, "t", "s"), ("b", "", "t", "s"), (None, "x", None, None)])
    assert filters.with_transcript(frame).count() == 2


def test_equal_if_given(spark):
    frame = records(spark, [("a", "x", "t", "s"), ("A", "x", "t", "s"), (None, "x", "t", "s")])
    assert filters.equal_if_given(frame, "patient_id", "a").count() == 1
    assert filters.equal_if_given(frame, "patient_id", None).count() == 3
    assert filters.equal_if_given(frame, "patient_id", "").count() == 3
    assert filters.equal_if_given(frame, "absent", "a").count() == 3


def test_pending_is_exact(spark):
    rows = [("Q1", "Pending"), ("Q2", "Pending Laboratory"), ("Q3", "pending"), ("Q4", None)]
    frame = spark.createDataFrame(rows, "request_id string, status string")
    assert [r[0] for r in filters.pending_requests(frame).collect()] == ["Q1"]


def test_queue_orders(spark):
    rows = [("Q1", "2026-01-01"), ("Q3", "2026-02-01"), ("Q2", "2026-02-01"), ("Q0", None)]
    frame = spark.createDataFrame(rows, "request_id string, date string")
    queue = request_queue(frame.withColumn("status", F.lit("Pending")))
    assert [r[0] for r in queue.collect()] == ["Q2", "Q3", "Q1", "Q0"]
    reports = frame.withColumnsRenamed({"request_id": "report_id"}).withColumn("patient_id", F.lit("p"))
    assert [r[0] for r in reports_of(reports, "p").collect()] == ["Q2", "Q3", "Q1", "Q0"]
    assert reports_of(reports, "P").isEmpty()


# -- record view ---------------------------------------------------------------------


def test_view_merges_copies_and_keeps_the_rest(spark):
    landing = records(
        spark,
        [
            ("p1", "Yes.", "2026-03-01T10:00:00.100000", "dispensed"),
            ("p1", "Yes.", "2026-03-01T10:00:00.900000", "pending_pharmacy"),
            ("p1", "Yes.", "2026-03-01T10:00:01.000000", "pending_pharmacy"),
            ("p2", "Yes.", "2026-03-02T10:00:00", "pending_pharmacy"),
            ("p3", None, "2026-03-03T10:00:00", "x"),
            ("p4", "lost time", "junk", "x"),
            ("p4", "lost time", None, "y"),
            (None, None, None, None),
        ],
    )
    view = rows_of(records_view(landing))
    assert view == sorted(
        [
            ("p1", "Yes.", "2026-03-01 10:00:00", "pending_pharmacy"),
            ("p1", "Yes.", "2026-03-01 10:00:01", "pending_pharmacy"),
            ("p2", "Yes.", "2026-03-02 10:00:00", "pending_pharmacy"),
            ("p3", None, "2026-03-03 10:00:00", "x"),
            *[row for row in view if row[1] == "lost time"],
        ],
        key=repr,
    )
    assert len([row for row in view if row[1] == "lost time"]) == 1
    assert records_view(landing, keep_empty=True).count() == len(view) + 1


def test_view_prefers_landing_and_filters_before_dedup(spark):
    stamp = "2026-03-01T10:00:00.100000"
    landing = records(spark, [("p1", "t", stamp, "dispensed")])
    table = records(spark, [("p1", "t", stamp, "pending_pharmacy")]).withColumn("is_leak", F.lit(False))
    assert [r["status"] for r in records_view(landing, table).collect()] == ["dispensed"]
    # The stale table row shows under its own status: the filter comes first.
    pending = records_view(landing, table, status="pending_pharmacy").collect()
    assert [(r["status"], r["is_leak"]) for r in pending] == [("pending_pharmacy", False)]
    assert records_view(landing, table, patient_id="p2").isEmpty()


def test_view_orders_newest_first_with_unreadable_times_last(spark):
    rows = [("p", str(i), f"2026-03-{i:02d}T00:00:00", "s") for i in range(1, 20)]
    landing = records(spark, [*rows, ("p", "junk", "junk", "s")])
    seen = [r["raw_transcript"] for r in records_view(landing, ordered=True).collect()]
    assert seen == [str(i) for i in range(19, 0, -1)] + ["junk"]


def test_view_is_the_same_whatever_the_order_of_its_input(spark):
    rows = [
        ("p%d" % (i % 3), "t%d" % (i % 2), "2026-03-01T10:00:00.5", "s%d" % i) for i in range(40)
    ]
    first = rows_of(records_view(records(spark, rows)))
    random.Random(1).shuffle(rows)
    assert rows_of(records_view(records(spark, rows).repartition(7))) == first


def test_audits_is_the_view(spark):
    landing = records(spark, [("p1", "t", "2026-03-01T10:00:00", "s")])
    register_audits(landing)
    assert spark.table("audits").count() == 1


# -- last visits, history, bundle -----------------------------------------------------


def test_history_takes_three_and_tells_missing_dates(spark):
    rows = [
        ("p1", ["a"], "d%d" % i, "m", "2026-03-0%dT00:00:00" % i) for i in range(1, 6)
    ] + [("p2", None, None, None, None), (None, ["z"], "d", "m", "t")]
    ddl = "patient_id string, symptoms array<string>, diagnosis string, medication string, timestamp string"
    frame = spark.createDataFrame(rows, ddl)
    got = dict(rows_of(history.patient_history(frame, indented=False)))
    assert set(got) == {"p1", "p2"}
    assert [part.split('"')[3] for part in got["p1"].split("},")] == [
        "2026-03-05T00:00:00", "2026-03-04T00:00:00", "2026-03-03T00:00:00",
    ]
    only = history.patient_history(frame, spark.createDataFrame([("p2",), ("p2",), ("p9",)], "patient_id string"))
    assert [r["patient_id"] for r in only.collect()] == ["p2"]
    assert got["p2"] == '[{"date":"Unknown","diagnosis":"N/A","medication":"N/A","symptoms":[]}]'


def test_attach_history_tells_when_there_is_none(spark):
    conversations = spark.createDataFrame([("c1", "p1"), ("c2", None)], "consult_id string, patient_id string")
    known = spark.createDataFrame([("p1", "[..]")], "patient_id string, history string")
    got = {r["consult_id"]: r["history"] for r in history.attach_history(conversations, known).collect()}
    assert got == {"c1": "[..]", "c2": fv.NO_HISTORY}


def test_patient_bundle_and_overview(spark):
    rows = records(spark, [("p1", "a", "2026-01-02T00:00:00", "s"), ("p1", "b", "2026-01-01T00:00:00", "s")])
    reports = spark.createDataFrame(
        [("R1", "p1", "2026-01-03"), ("R2", "p2", "2026-01-04")],
        "report_id string, patient_id string, date string",
    )
    bundle = rows_of(history.patient_bundle(rows, reports).drop("document"))
    assert bundle == [
        ("p1", "lab_report", "2026-01-03"),
        ("p1", "record", "2026-01-01T00:00:00"),
        ("p1", "record", "2026-01-02T00:00:00"),
        ("p2", "lab_report", "2026-01-04"),
    ]
    assert rows_of(history.patient_overview(rows, reports)) == [
        ("p1", 2, "2026-01-02T00:00:00", 1, "2026-01-03"),
        ("p2", 0, None, 1, "2026-01-04"),
    ]


# -- folds ------------------------------------------------------------------------------


def test_fold_is_the_lines_in_turn_order_whatever_the_stretch(spark):
    rng = random.Random(3)
    lines = [
        (f"c{c}", turn, rng.choice(["doctor", "patient"]), f"text {turn}\nsecond line ನ")
        for c in range(4)
        for turn in range(rng.randrange(1, 60))
    ]
    wanted = {}
    for consult, _, speaker, text in sorted(lines):
        label = "Doctor" if speaker == "doctor" else "Patient"
        wanted.setdefault(consult, []).append(f"{label}: {text}")
    wanted = {c: "\n".join(texts) for c, texts in wanted.items()}
    rng.shuffle(lines)
    frame = spark.createDataFrame(lines, "consult_id string, turn long, speaker string, text string")
    frame = frame.repartition(5).select(
        "consult_id", "turn", transcript_line(F.col("speaker"), F.col("text")).alias("line")
    )
    for stretch in (1, 7, 1024):
        assert dict(rows_of(folds.fold_conversations(frame, segment_turns=stretch))) == wanted
        segments = folds.conversation_segments(frame, segment_turns=stretch)
        joined = {}
        for consult, _, text in sorted(tuple(r) for r in segments.collect()):
            joined.setdefault(consult, []).append(text)
        assert {c: "\n".join(t) for c, t in joined.items()} == wanted
    assert frame.select(speaker_label(F.lit("x"))).first()[0] == "Patient"


# -- keyed updates ------------------------------------------------------------------------


def test_complete_requests(spark):
    requests = spark.createDataFrame(
        [("Q1", "Pending"), ("Q2", "Pending"), ("Q3", "Completed"), (None, "Pending")],
        "request_id string, status string",
    )
    reports = spark.createDataFrame([("Q1",), ("Q1",), ("Q9",), (None,)], "request_id string")
    once = keyed.complete_requests(requests, reports)
    wanted = [("Q1", "Completed"), ("Q2", "Pending"), ("Q3", "Completed"), (None, "Pending")]
    assert rows_of(once) == sorted(wanted, key=repr)
    assert rows_of(keyed.complete_requests(once, reports)) == rows_of(once)


def test_dispense_touches_every_record_of_the_patient(spark):
    rows = spark.createDataFrame(
        [("p1", "a", "pending"), ("p1", "b", None), ("p2", "a", "pending"), (None, "a", "pending")],
        "patient_id string, status string, pharmacy_status string",
    )
    events = spark.createDataFrame([("p1",), ("p1",), ("p9",), (None,)], "patient_id string")
    once = keyed.dispense(rows, events)
    assert rows_of(once) == sorted(
        [
            ("p1", "dispensed", "dispensed"),
            ("p1", "dispensed", "dispensed"),
            ("p2", "a", "pending"),
            (None, "a", "pending"),
        ],
        key=repr,
    )
    assert rows_of(keyed.dispense(once, events)) == rows_of(once)
    assert rows_of(keyed.unmatched_events(events, rows)) == [("p9",)]


def test_last_per_key(spark):
    rows = [("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, None), (None, 1, "n")]
    frame = spark.createDataFrame(rows, "k string, at int, v string")
    assert rows_of(keyed.last_per_key(frame, ["k"], ["at"])) == sorted(
        [("k", 3, "c"), ("j", 1, None), (None, 1, "n")], key=repr
    )


def test_attach_analyses_takes_the_latest(spark):
    reports = spark.createDataFrame([("R1",), ("R2",)], "report_id string")
    analyses = spark.createDataFrame(
        [("R1", 1, "old"), ("R1", 2, "new"), ("R9", 1, "x")], "report_id string, at int, summary string"
    )
    got = keyed.attach_analyses(reports, analyses, ["at"])
    assert rows_of(got) == [("R1", "new"), ("R2", None)]


def _update_by_hand(rows, events):
    out = []
    for patient, text, stamp, status in rows:
        hits = [
            (order, new)
            for etext, estamp, new, order in events
            if etext is not None
            and text == etext
            and stamp is not None
            and estamp is not None
            and estamp.split()
            and estamp.split()[0] in stamp
        ]
        out.append((patient, text, stamp, max(hits)[1] if hits else status))
    return sorted(out, key=repr)


def test_update_status_agrees_with_plain_containment(spark):
    rng = random.Random(11)
    stamps = [
        "2026-03-14T00:15:40.123456",
        "2026-03-14T00:15:41",
        "2026-03-15 10:00:00",
        "2026-04-01",
        "2026-03-14 2026-04-01",
        "12026-03-14",
        "junk stamp",
        "",
        None,
    ]
    tokens = [
        "2026-03-14 00:15:40",
        "2026-03-14T00:15:40.123456",
        "2026-03-14",
        "2026-04-01",
        "2026",
        "03-1",
        "40",
        ":15:4",
        "j",
        ".",
        "2026-03-14T00:15:4",
        "  ",
        "",
        None,
    ]
    texts = ["Yes.", "No.", "a\nb", "", None]
    rows = [
        (f"p{i}", rng.choice(texts), rng.choice(stamps), f"s{i}") for i in range(300)
    ]
    for count in (0, 5, 60):
        events = [
            (rng.choice(texts), rng.choice(tokens), None if i % 9 == 8 else f"n{i}", i)
            for i in range(count)
        ]
        frame = spark.createDataFrame(
            events, "raw_transcript string, timestamp string, status string, n int"
        )
        got = rows_of(keyed.update_status(records(spark, rows), frame, ["n"]))
        assert got == _update_by_hand(rows, events)


def _fold_by_hand(rows, log):
    def at(text):
        return dt.datetime.fromisoformat(text)

    out = []
    for patient, text, stamp, status, pharmacy in rows:
        served = [
            at(e["event_time"])
            for e in log
            if e["raw_transcript"] is None
            and e["patient_id"] == patient
            and at(stamp) <= at(e["event_time"])
        ]
        named = [
            (at(e["event_time"]), e["status"])
            for e in log
            if e["raw_transcript"] is not None
            and e["raw_transcript"] == text
            and e["timestamp"].split()[0] in stamp
            and at(stamp) <= at(e["event_time"])
        ]
        if served:
            pharmacy = "dispensed"
        if served and (not named or max(served) >= max(named)[0]):
            status = "dispensed"
        elif named:
            status = max(named)[1]
        out.append((patient, text, stamp, status, pharmacy))
    return sorted(out, key=repr)


def random_status_case(seed):
    rng = random.Random(seed)
    days = ["2026-03-%02d" % d for d in range(1, 8)]
    rows = [
        (f"p{rng.randrange(5)}", f"t{rng.randrange(4)}", f"{rng.choice(days)}T0{rng.randrange(9)}:00:00",
         "pending_pharmacy", "pending")
        for _ in range(120)
    ]
    log = []
    for i in range(25):
        dispense = rng.random() < 0.4
        log.append(
            {
                "patient_id": f"p{rng.randrange(7)}" if dispense else None,
                "timestamp": f"{rng.choice(days)} 00:00:00",
                "raw_transcript": None if dispense else f"t{rng.randrange(4)}",
                "status": "dispensed" if dispense else f"n{i}",
                "event_time": f"{rng.choice(days)}T0{rng.randrange(9)}:30:00",
            }
        )
    return rows, log


STATES = SHORT + ", pharmacy_status string"
EVENTS = "patient_id string, timestamp string, raw_transcript string, status string, event_time string"


def test_fold_status_takes_the_latest_matching_event(spark):
    for seed in range(3):
        rows, log = random_status_case(seed)
        events = spark.createDataFrame([tuple(e.values()) for e in log], EVENTS)
        folded = status_log.fold_status(spark.createDataFrame(rows, STATES), events)
        wanted = _fold_by_hand(rows, log)
        assert rows_of(folded) == wanted
        pending = status_log.pending_queue(spark.createDataFrame(rows, STATES), events)
        assert rows_of(pending) == [r for r in wanted if r[3] == "pending_pharmacy"]


def test_events_reach_no_younger_record_and_need_a_time(spark):
    rows = [
        ("p1", "t1", "2026-03-01T00:00:00", "old", "pending"),
        ("p1", "t1", "2026-03-01T20:00:00", "young", "pending"),
        ("p1", "t1", None, "undated", "pending"),
        ("p2", "t2", "2026-03-01T00:00:00", "old", "pending"),
    ]
    events = [
        ("p1", "any", None, "dispensed", "2026-03-01T10:00:00"),
        (None, "2026-03-01", "t1", "reviewed", "2026-03-01T09:00:00"),
        ("p2", "any", None, "dispensed", "no time"),
        (None, "2026-03-01", "t2", "reviewed", None),
    ]
    folded = status_log.fold_status(
        spark.createDataFrame(rows, STATES), spark.createDataFrame(events, EVENTS)
    )
    assert [r[3:] for r in rows_of(folded.sort("patient_id"))] == [
        ("dispensed", "dispensed"), ("young", "pending"), ("dispensed", "dispensed"), ("old", "pending"),
    ]


def test_requests_become_events(spark):
    at = F.lit("2026-03-01 10:00:00").cast("timestamp")
    asked = spark.createDataFrame([("p1", "2026-02-01 09:00:00")], "patient_id string, timestamp string")
    renamed = spark.createDataFrame(
        [("2026-02-01 09:00:00", "t1", "reviewed")], "timestamp string, raw_transcript string, status string"
    )
    events = dispense_events(asked, at).unionByName(update_events(renamed, at))
    assert events.columns == STATUS_EVENT.names
    assert rows_of(events) == sorted(
        [
            ("p1", "2026-02-01 09:00:00", None, "dispensed", "2026-03-01T10:00:00.000000"),
            (None, "2026-02-01 09:00:00", "t1", "reviewed", "2026-03-01T10:00:00.000000"),
        ],
        key=repr,
    )


# -- union, counts -----------------------------------------------------------------------


def test_union_widens_both_ways(spark):
    left = spark.createDataFrame([("a", 1)], "x string, y int")
    right = spark.createDataFrame([("b", True)], "x string, z boolean")
    assert rows_of(dedup.union_widened(left, right)) == [("a", 1, None), ("b", None, True)]


def test_counts(spark):
    frame = spark.createDataFrame([("a",), ("a",), (None,)], "status string")
    assert counts.row_count(frame).first()[0] == 3
    assert rows_of(counts.status_counts(frame)) == [("a", 2), (None, 1)]
    assert counts.has_rows(frame) and not counts.has_rows(frame.limit(0))
    observed, seen = counts.counted(frame)
    observed.collect()
    assert seen.get == {"rows": 3}


def test_clinical_schema_survives_the_view(spark):
    landing = spark.createDataFrame(
        [("p", ["s"], "d", None, "", None, "t", "2026-03-01T00:00:00", "x", "pending")], CLINICAL_RECORD
    )
    row = records_view(landing).first().asDict()
    assert row["symptoms"] == ["s"] and row["timestamp"] == "2026-03-01 00:00:00"
