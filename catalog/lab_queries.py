"""Lab reports: lines, severity, short form, parsing, analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import LAB_REPORTS, RECORDS, lab_reports, read, records, sql_text
from wardbook import fixed_values as fv
from wardbook.functions import lab
from wardbook.plans.extraction import add_requested_test
from wardbook.plans.lab_loop import analyse_reports, analysis_prompts, with_analysis
from wardbook.plans.prompts import ANALYSIS_PROMPT, TESTS_SLOT

_LINES = r"""array_to_string(list_transform(lab_tests, lambda t: '- ' || t.test_name || ': ' || t.value
  || ' (Normal: ' || t.normal_range || ') - Status: ' || t.status), '\n')"""


@query(f"WITH {LAB_REPORTS} SELECT report_id, {_LINES} AS lines FROM lab_reports")
def lab_lines(spark, sf_dir):
    return lab_reports(spark, sf_dir).select("report_id", lab.lab_lines(F.col("lab_tests")).alias("lines"))


@query(
    f"""WITH {LAB_REPORTS} SELECT report_id,
      array_to_string(list_transform(lab_tests[1:2], lambda t: t.test_name), '|') AS first_two,
      CAST(greatest(len(lab_tests) - 2, 0) AS INTEGER) AS more,
      CASE WHEN len(lab_tests) > 2 THEN '+' || (len(lab_tests) - 2) || ' more tests' END AS more_label
    FROM lab_reports"""
)
def first_two_more(spark, sf_dir):
    return lab_reports(spark, sf_dir).select(
        "report_id",
        F.array_join(lab.first_tests(F.col("lab_tests"))["test_name"], "|").alias("first_two"),
        lab.hidden_tests(F.col("lab_tests")).alias("more"),
        lab.more_label(F.col("lab_tests")).alias("more_label"),
    )


def _severity_sql(arms: str, name: str) -> str:
    return (
        f"array_to_string(list_transform(lab_tests, lambda t: CASE WHEN t.status = 'NORMAL'"
        f" THEN 'ok' {arms} END), '|') AS {name}"
    )


_HIGH_LOW = "WHEN t.status IN ('HIGH', 'LOW') THEN 'warn'"


@query(
    f"""WITH {LAB_REPORTS} SELECT report_id,
      {_severity_sql(_HIGH_LOW + " WHEN t.status = 'FAIL' THEN 'fail' ELSE 'neutral'", "patient")},
      {_severity_sql(_HIGH_LOW + " ELSE 'fail'", "doctor")},
      {_severity_sql("ELSE 'warn'", "laboratory")} FROM lab_reports"""
)
def lab_severity(spark, sf_dir):
    screens = ("patient", "doctor", "laboratory")
    shown = [F.array_join(lab.severities(F.col("lab_tests"), s), "|").alias(s) for s in screens]
    return lab_reports(spark, sf_dir).select("report_id", *shown)


@query(
    f"""WITH {LAB_REPORTS} SELECT report_id,
      CASE WHEN report_type = 'O' THEN array_to_string(
        list_transform(lab_tests, lambda t: t.test_name || '=' || t.value || '/' || t.status), '|')
      ELSE '' END AS parsed FROM lab_reports"""
)
def parse_tests(spark, sf_dir):
    text = F.when(F.col("report_type") == "O", F.to_json("lab_tests")).otherwise(
        F.concat(F.lit("{not json "), "date")
    )
    uploads = lab_reports(spark, sf_dir).select("report_id", text.alias("text"))
    shown = F.transform(
        lab.parse_tests(F.col("text")),
        lambda t: F.concat(t["test_name"], F.lit("="), t["value"], F.lit("/"), t["status"]),
    )
    return uploads.select("report_id", F.array_join(shown, "|").alias("parsed"))


def _analysis_prompt_sql() -> str:
    before, after = ANALYSIS_PROMPT.split(TESTS_SLOT)
    return f"{sql_text(before)} || {_LINES} || {sql_text(after)}"


@query(f"WITH {LAB_REPORTS} SELECT report_id, {_analysis_prompt_sql()} AS prompt FROM lab_reports")
def lab_prompt(spark, sf_dir):
    return analysis_prompts(lab_reports(spark, sf_dir)).drop("prompt_key")


@query(
    f"""WITH {RECORDS} SELECT event_id,
      array_to_string(list_append(coalesce(lab_tests, []), raw_transcript || ' - Pending Laboratory'), '|')
        AS lab_tests,
      array_to_string(symptoms, '|') AS symptoms, diagnosis, medication, dosage FROM records"""
)
def append_lab_test(spark, sf_dir):
    drafts = add_requested_test(records(spark, sf_dir), "raw_transcript")
    return drafts.select(
        "event_id",
        F.array_join("lab_tests", "|").alias("lab_tests"),
        F.array_join("symptoms", "|").alias("symptoms"),
        "diagnosis",
        "medication",
        "dosage",
    )


def _analysis_client():
    """Reads the number of characters back, once as JSON and once without."""

    def answer(prompt: str, model: str) -> str:
        if "discount" in prompt:
            return '{"summary": "%d", "recommendation": "%s"}' % (len(prompt), model)
        return "no opinion"

    return answer


_SUMMARY, _RISK, _ADVICE = fv.ANALYSIS_UNAVAILABLE


@query(
    f"""WITH {LAB_REPORTS}, prompts AS (
      SELECT report_id, {_analysis_prompt_sql()} AS prompt FROM lab_reports)
    SELECT report_id,
      CASE WHEN contains(prompt, 'discount') THEN CAST(length(prompt) AS VARCHAR) ELSE '{_SUMMARY}' END
        AS summary,
      CASE WHEN contains(prompt, 'discount') THEN NULL ELSE '{_RISK}' END AS risk_level,
      CASE WHEN contains(prompt, 'discount') THEN 'm' ELSE '{_ADVICE}' END AS recommendation
    FROM prompts"""
)
def lab_analysis_stub(spark, sf_dir):
    return analyse_reports(spark, lab_reports(spark, sf_dir), _analysis_client(), "m")


@query(
    f"""SELECT event_id,
      CASE event_type WHEN 'view' THEN json_extract_string(props, '$.k') ELSE '{_SUMMARY}' END AS summary,
      CASE event_type WHEN 'view' THEN NULL ELSE '{_RISK}' END AS risk_level,
      CASE event_type WHEN 'view' THEN 'x' ELSE '{_ADVICE}' END AS recommendation FROM events"""
)
def analysis_parse(spark, sf_dir):
    number = F.get_json_object("props", "$.k")
    answer = F.concat(F.lit('Sure. {"summary": '), number, F.lit(', "recommendation": "x"}'))
    response = F.when(F.col("event_type") == "view", answer).otherwise(F.col("event_type"))
    answers = read(spark, sf_dir, "events").select("event_id", response.alias("response"))
    return with_analysis(answers).drop("response")


_NO_MODEL = ", ".join(
    f"{sql_text(text)} AS {key}"
    for key, text in zip(fv.ANALYSIS_KEYS, fv.ANALYSIS_NOT_CONFIGURED, strict=True)
)


@query(f"WITH {LAB_REPORTS} SELECT report_id, {_NO_MODEL} FROM lab_reports")
def lab_analysis_unconfigured(spark, sf_dir):
    return analyse_reports(spark, lab_reports(spark, sf_dir), None)
