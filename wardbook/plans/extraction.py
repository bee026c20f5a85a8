"""Conversations to structured drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.json_text import (
    default_draft,
    json_object_in,
    overlay_draft,
    parsed_object,
)
from wardbook.functions.lab import append_pending_test
from wardbook.functions.transcript import long_enough, transcript_line
from wardbook.operators.folds import fold_conversations
from wardbook.operators.history import attach_history, patient_history
from wardbook.plans.model_stage import Client, with_prompt_key, with_readings
from wardbook.plans.prompts import EXTRACTION_PROMPT, extraction_prompt


def conversations_from(lines: DataFrame) -> DataFrame:
    """``(consult_id, conversation)`` from transcript lines."""
    spoken = lines.withColumn("line", transcript_line(F.col("speaker"), F.col("text")))
    return fold_conversations(spoken.select("consult_id", "turn", "line"))


def extraction_prompts(
    conversations: DataFrame, records: DataFrame, template: str = EXTRACTION_PROMPT
) -> DataFrame:
    """Conversations with their prompt, null where the text is too short."""
    known = attach_history(conversations, patient_history(records, conversations))
    text = F.col("conversation")
    prompt = extraction_prompt(F.col("history"), text, template)
    return with_prompt_key(known.withColumn("prompt", F.when(long_enough(text), prompt)))


def with_drafts(rows: DataFrame, response: str = "response") -> DataFrame:
    """The draft's columns from the answer; defaults without one.

    The parsed answer is a column of its own, so that it is parsed once.
    """
    found = rows.withColumn("__found", json_object_in(F.col(response)))
    parsed = found.withColumn("__parsed", parsed_object(F.col("__found")))
    drafts = parsed.withColumns(overlay_draft(F.col("__parsed"), F.col("__found")))
    return drafts.drop("__found", "__parsed")


def draft_prescriptions(
    spark: SparkSession,
    conversations: DataFrame,
    records: DataFrame,
    client: Client | None,
    models: list[str],
    store: str | None = None,
    template: str = EXTRACTION_PROMPT,
    **options,
) -> DataFrame:
    """Each conversation (consult_id, patient_id, conversation) with its draft.

    Without a client, every draft is the default one.
    """
    prompts = extraction_prompts(conversations, records, template).drop("history")
    defaults = default_draft()
    if client is None:
        return prompts.drop("prompt", "prompt_key").withColumns(defaults)
    return with_readings(spark, prompts, client, models, with_drafts, defaults, store, **options)


def add_requested_test(drafts: DataFrame, test: str) -> DataFrame:
    """a requested lab test on every draft; a missing draft starts empty.

    A row without a draft has null in all its columns.
    """
    no_draft = F.coalesce(*(F.col(c).cast("string") for c in fv.DRAFT_KEYS)).isNull()
    started = {
        name: F.when(no_draft, text).otherwise(F.col(name)) for name, text in fv.EMPTY_DRAFT.items()
    }
    started["symptoms"] = F.when(no_draft, F.array().cast("array<string>")).otherwise(
        F.col("symptoms")
    )
    started["lab_tests"] = append_pending_test(F.col("lab_tests"), F.col(test))
    return drafts.withColumns(started)
