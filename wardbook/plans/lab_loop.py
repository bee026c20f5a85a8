"""Lab requests, lab reports and their analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.json_text import (
    analysis_fields,
    default_analysis,
    json_object_in,
    parsed_object,
)
from wardbook.functions.lab import lab_lines
from wardbook.operators.dedup import by_date_desc
from wardbook.operators.filters import of_patient, pending_requests
from wardbook.operators.keyed import complete_requests
from wardbook.plans.model_stage import Client, with_prompt_key, with_readings
from wardbook.plans.prompts import ANALYSIS_PROMPT, analysis_prompt


def request_queue(requests: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Pending requests, latest date first; with ``reports``, those without one."""
    current = requests if reports is None else complete_requests(requests, reports)
    return by_date_desc(pending_requests(current), "request_id")


def reports_of(reports: DataFrame, patient_id: str) -> DataFrame:
    """P5, O2: one patient's reports, latest date first."""
    return by_date_desc(of_patient(reports, patient_id), "report_id")


def analysis_prompts(reports: DataFrame, template: str = ANALYSIS_PROMPT) -> DataFrame:
    """``(report_id, prompt, prompt_key)``."""
    lines = F.coalesce(lab_lines(F.col("lab_tests")), F.lit(""))
    return with_prompt_key(
        reports.select("report_id", analysis_prompt(lines, template).alias("prompt"))
    )


def with_analysis(rows: DataFrame, response: str = "response") -> DataFrame:
    """the analysis columns from the answer, parsed once."""
    parsed = rows.withColumn("__parsed", parsed_object(json_object_in(F.col(response))))
    return parsed.withColumns(analysis_fields(F.col("__parsed"))).drop("__parsed")


def analyse_reports(
    spark: SparkSession,
    reports: DataFrame,
    client: Client | None,
    model: str = "",
    store: str | None = None,
    template: str = ANALYSIS_PROMPT,
    **options,
) -> DataFrame:
    """``(report_id, summary, risk_level, recommendation)``.

    One call per report and no second try; failures and unreadable answers give
    the fixed fallback, and without a client every row says so.
    """
    if client is None:
        notes = zip(fv.ANALYSIS_KEYS, fv.ANALYSIS_NOT_CONFIGURED, strict=True)
        return reports.select("report_id", *(F.lit(text).alias(key) for key, text in notes))
    prompts = analysis_prompts(reports, template)
    once = {"tries": 1, "wait_seconds": 0, **options}
    return with_readings(
        spark, prompts, client, [model], with_analysis, default_analysis(), store, **once
    )
