"""Prompt texts. The wording is this project's own; callers may pass another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardbook import fixed_values as fv

HISTORY_SLOT = "<<history>>"
CONVERSATION_SLOT = "<<conversation>>"
TESTS_SLOT = "<<tests>>"

EXTRACTION_PROMPT = f"""Read the consultation below and write down what was found and prescribed.
Keep it consistent with the patient's earlier visits.

Earlier visits, newest first, at most {fv.HISTORY_VISITS}:
{HISTORY_SLOT}

Consultation:
{CONVERSATION_SLOT}

Answer with one JSON object and nothing else. Its keys:
symptoms - list of texts
diagnosis - text, "{fv.EMPTY_DRAFT["diagnosis"]}" while unclear
medication - text, "{fv.EMPTY_DRAFT["medication"]}" if there is none
dosage - text, "{fv.EMPTY_DRAFT["dosage"]}" if there is none
lab_tests - list of texts
Without medical content, give empty lists, the diagnosis
"{fv.EMPTY_DRAFT["diagnosis"]} - insufficient information" and "None" for the other texts."""

ANALYSIS_PROMPT = f"""Explain these laboratory results to a physician.
{TESTS_SLOT}

Answer with one JSON object and nothing else. Its keys:
summary - one or two sentences
risk_level - {fv.RISK_LEVELS}
recommendation - what to do next"""


def filled(template: str, slots: dict[str, Column]) -> Column:
    """A template with its slots replaced by columns, in one concatenation."""
    parts: list[str | Column] = [template]
    for slot, value in slots.items():
        parts = [piece for part in parts for piece in _split(part, slot, value)]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _split(part: str | Column, slot: str, value: Column) -> list[str | Column]:
    if not isinstance(part, str) or slot not in part:
        return [part]
    before, after = part.split(slot, 1)
    return [before, value, after]


def extraction_prompt(
    history: Column, conversation: Column, template: str = EXTRACTION_PROMPT
) -> Column:
    """history (or the note that there is none) and the conversation."""
    known = F.coalesce(history, F.lit(fv.NO_HISTORY))
    return filled(template, {HISTORY_SLOT: known, CONVERSATION_SLOT: conversation})


def analysis_prompt(lines: Column, template: str = ANALYSIS_PROMPT) -> Column:
    """the lines of a lab report."""
    return filled(template, {TESTS_SLOT: lines})
