from __future__ import annotations

import json
import os
import re
from datetime import date
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.plans.extraction import conversations_from, draft_prescriptions
from wardbook.plans.lab_loop import analyse_reports
from wardbook.plans.model_stage import (
    answer_once,
    answers_in,
    ask,
    dealt,
    forget_answers,
    prefixes_of,
    with_prompt_key,
)
from wardbook.schemas import CLINICAL_RECORD, LAB_REPORT, TRANSCRIPT_LINE


def prompts(spark, texts):
    return with_prompt_key(spark.createDataFrame([(t,) for t in texts], "prompt string"))


def scripted(calls_file, script):
    """A client that logs its calls and answers from ``script[model]``, in turn."""

    def client(prompt, model):
        with open(calls_file, "a") as calls:
            calls.write(json.dumps([prompt, model]) + "\n")
        with open(calls_file) as calls:
            made = sum(json.loads(line) == [prompt, model] for line in calls)
        step = script[model][min(made, len(script[model])) - 1]
        if step.startswith("raise "):
            raise RuntimeError(step.removeprefix("raise "))
        return None if step == "none" else step

    return client


def calls_in(path):
    with open(path) as calls:
        return [tuple(json.loads(line)) for line in calls]


def test_rate_limits_are_retried_and_other_errors_are_not(spark, folder):
    cases = [
        ({"a": ["fine"]}, ["a"], ("fine", "a", 1, None)),
        ({"a": ["raise 429 slow down", "fine"]}, ["a"], ("fine", "a", 2, None)),
        ({"a": ["raise RESOURCE_EXHAUSTED"], "b": ["ok"]}, ["a", "b"], ("ok", "b", 3, None)),
        ({"a": ["raise broken"], "b": ["ok"]}, ["a", "b"], ("ok", "b", 2, None)),
        ({"a": ["none"], "b": ["ok"]}, ["a", "b"], ("ok", "b", 2, None)),
        ({"a": ["no json at all"], "b": ["ok"]}, ["a", "b"], ("no json at all", "a", 1, None)),
        ({"a": ["raise x"], "b": ["raise 429"]}, ["a", "b"], (None, None, 3, "429")),
    ]
    for script, models, wanted in cases:
        client = scripted(folder("calls"), script)
        got = ask(prompts(spark, ["p"]), client, models, wait_seconds=0, parallel_calls=2).collect()
        assert [tuple(r)[1:] for r in got] == [wanted]


def test_waits_grow(spark, folder):
    import time

    client = scripted(folder("calls"), {"a": ["raise 429", "raise 429", "late"]})
    start = time.monotonic()
    row = ask(prompts(spark, ["p"]), client, ["a"], tries=3, wait_seconds=0.2).first()
    assert row["response"] == "late" and time.monotonic() - start >= 0.6


def test_equal_prompts_are_asked_once_and_answers_are_kept(spark, folder):
    calls, store = folder("calls"), folder("store")
    client = scripted(calls, {"a": ["yes"]})
    first = answer_once(spark, prompts(spark, ["p", "p", "q", None]), client, ["a"], store)
    assert first.count() == 2
    again = answer_once(spark, prompts(spark, ["p", "r"]), client, ["a"], store)
    # The answers under the prefixes of these prompts; "q" may have another one.
    assert again.count() in (2, 3) and answers_in(spark, store).count() == 3
    assert sorted(calls_in(calls)) == [("p", "a"), ("q", "a"), ("r", "a")]


def test_failures_are_asked_again(spark, folder):
    calls, store = folder("calls"), folder("store")
    client = scripted(calls, {"a": ["raise down", "up"]})
    assert answer_once(spark, prompts(spark, ["p"]), client, ["a"], store).isEmpty()
    answer_once(spark, prompts(spark, ["p"]), client, ["a"], store)
    assert [r["response"] for r in answers_in(spark, store).collect()] == ["up"]


def test_answers_given_before_a_crash_are_not_asked_again(spark, folder):
    calls, store = folder("calls"), folder("store")
    texts = [f"p{i}" for i in range(6)]

    def mortal(prompt, model):
        if prompt == "p3":
            os._exit(1)
        return prompt.upper()

    sizes = {"calls_per_task": 1, "files_per_batch": 1}
    with pytest.raises(Exception, match="(?i)terminated|crashed|exited"):
        answer_once(spark, prompts(spark, texts), mortal, ["a"], store, **sizes)
    kept = answers_in(spark, store).count()
    assert kept < 6
    answer_once(spark, prompts(spark, texts), scripted(calls, {"a": ["ok"]}), ["a"], store, **sizes)
    assert len(calls_in(calls)) == 6 - kept
    assert answers_in(spark, store).count() == 6


def test_drafts_of_conversations(spark, folder):
    lines = spark.createDataFrame(
        [
            ("c1", 1, "patient", "My head hurts a lot"),
            ("c1", 0, "doctor", "What is wrong?"),
            ("c2", 0, "doctor", "Hi"),
            ("c3", 0, "doctor", "Nothing to see here"),
        ],
        TRANSCRIPT_LINE,
    )
    visit = ("p1", ["x"], "earlier cold", "rest", None, None, "t", "2026-01-01T00:00:00", "s", None)
    records = spark.createDataFrame([visit], CLINICAL_RECORD)
    conversations = conversations_from(lines).withColumn(
        "patient_id", F.when(F.col("consult_id") == "c1", "p1")
    )
    calls = folder("calls")

    def client(prompt, model):
        with open(calls, "a") as out:
            out.write(json.dumps([prompt, model]) + "\n")
        if "head" in prompt:
            return '{"diagnosis": "headache", "symptoms": ["pain"], "medication": "None"}'
        return "no idea"

    drafts = draft_prescriptions(spark, conversations, records, client, ["m"])
    got = {r["consult_id"]: r.asDict() for r in drafts.collect()}
    assert (got["c1"]["diagnosis"], got["c1"]["symptoms"], got["c1"]["medication"]) == (
        "headache", ["pain"], "None",
    )
    assert got["c1"]["dosage"] == fv.DRAFT_TEXT_DEFAULTS["dosage"]
    for consult in ("c2", "c3"):
        assert {k: got[consult][k] for k in fv.DRAFT_TEXT_DEFAULTS} == fv.DRAFT_TEXT_DEFAULTS
    asked = [prompt for prompt, _ in calls_in(calls)]
    assert len(asked) == 2  # "Doctor: Hi" is too short
    with_head = next(p for p in asked if "head" in p)
    assert "Doctor: What is wrong?\nPatient: My head hurts a lot" in with_head
    assert "earlier cold" in with_head
    assert fv.NO_HISTORY in next(p for p in asked if "Nothing" in p)
    untouched = draft_prescriptions(spark, conversations, records, None, [])
    assert {r["diagnosis"] for r in untouched.collect()} == {"General consultation"}


def test_analyses_of_reports(spark, folder):
    reports = spark.createDataFrame(
        [
            ("R1", "p", "t", "d", None, [("Iron", "7", "8-12", "LOW")], None),
            ("R2", "p", "t", "d", None, [("Zinc", "1", "1", "NORMAL")], None),
            ("R3", "p", "t", "d", None, None, None),
        ],
        LAB_REPORT,
    )
    calls = folder("calls")

    def client(prompt, model):
        with open(calls, "a") as out:
            out.write(json.dumps([prompt, model]) + "\n")
        if "Iron" in prompt:
            return 'Sure {"summary": "low iron", "risk_level": "Low", "recommendation": "eat"}'
        if "Zinc" in prompt:
            raise RuntimeError("429")
        return "?"

    got = rows_of(analyse_reports(spark, reports, client, "m"))
    assert got == [
        ("R1", "low iron", "Low", "eat"),
        ("R2", *fv.ANALYSIS_UNAVAILABLE),
        ("R3", *fv.ANALYSIS_UNAVAILABLE),
    ]
    assert len(calls_in(calls)) == 3  # no second try
    assert rows_of(analyse_reports(spark, reports, None)) == [
        (r, *fv.ANALYSIS_NOT_CONFIGURED) for r in ("R1", "R2", "R3")
    ]


def test_no_task_makes_more_calls_than_allowed(spark, folder):
    calls = folder("calls")
    os.mkdir(calls)

    def client(prompt, model):
        from pyspark import TaskContext

        task = TaskContext.get()
        with open(f"{calls}/{task.stageId()}-{task.partitionId()}", "a") as made:
            made.write("x")
        return "ok"

    texts = [f"prompt {i}" for i in range(600)]
    asked = prompts(spark, texts).repartition(60)
    answers = answer_once(spark, asked, client, ["a"], folder("store"), calls_per_task=20)
    assert answers.count() == 600
    sizes = [os.path.getsize(f"{calls}/{name}") for name in os.listdir(calls)]
    assert sum(sizes) == 600 and max(sizes) <= 20 and len(sizes) == 30


@pytest.mark.parametrize("parts", [1, 8, 312, 498, 600])
def test_rows_are_dealt_to_as_few_tasks_as_can_be(spark, parts):
    rows = prompts(spark, ["p"]).crossJoin(spark.range(20_000)).select("prompt_key", "prompt", "id")
    tasks = dealt(rows.repartition(parts), 500)
    assert tasks.rdd.getNumPartitions() == 40
    sizes = tasks.groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in sizes] == [500] * 40
    assert tasks.select("id").distinct().count() == 20_000
    assert dealt(rows.limit(0), 500).count() == 0


def test_only_the_prefixes_of_a_run_are_read(spark, folder):
    store = folder("store")
    client = scripted(folder("calls"), {"a": ["yes"]})
    answer_once(spark, prompts(spark, [f"p{i}" for i in range(60)]), client, ["a"], store)
    few = prompts(spark, ["p1", "p2"])
    found = answers_in(spark, store, prefixes_of(few))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*key_prefix", plan)
    assert len(prefixes_of(few)) == 2 and 2 <= found.count() < 60


def test_old_answers_are_asked_again_and_forgotten(spark, folder):
    calls, store = folder("calls"), folder("store")
    client = scripted(calls, {"a": ["yes"]})
    answer_once(spark, prompts(spark, ["p", "q"]), client, ["a"], store)
    for place in Path(store).glob("key_prefix=*/answered_on=20*"):
        place.rename(place.parent / "answered_on=2020-01-05")
    assert answer_once(spark, prompts(spark, ["p"]), client, ["a"], store).count() == 1
    assert len(calls_in(calls)) == 2
    answer_once(spark, prompts(spark, ["p"]), client, ["a"], store, max_age_days=30)
    assert len(calls_in(calls)) == 3
    assert forget_answers(spark, store, date(2021, 1, 1)) == 2
    assert answers_in(spark, store).count() == 1
    assert answer_once(spark, prompts(spark, ["p", "q"]), client, ["a"], store).count() == 2
    assert len(calls_in(calls)) == 4


def test_no_prompt_is_kept(spark, folder, monkeypatch):
    from wardbook.plans import model_stage

    places = []
    monkeypatch.setattr(
        model_stage, "shared_folder", lambda s, label: places.append(folder(label)) or places[-1]
    )
    reports = spark.createDataFrame([("R1", "p", "t", "d", None, [("Iron", "7", "8-12", "LOW")], None)], LAB_REPORT)
    assert analyse_reports(spark, reports, lambda p, m: "{}", "m").count() == 1
    kept = [p for p in places if os.path.exists(p)]
    assert sorted(os.path.basename(p).split("-")[0] for p in kept) == ["answers", "rows"]
    assert "prompt" not in spark.read.parquet(next(p for p in kept if "rows" in os.path.basename(p))).columns
