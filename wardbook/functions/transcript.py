"""Transcript lines, language routing and the keyword rule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardbook import fixed_values as fv


def _is_doctor(speaker: Column) -> Column:
    return F.coalesce(F.lower(speaker) == fv.DOCTOR_LABEL.lower(), F.lit(False))


def speaker_label(speaker: Column) -> Column:
    """``Doctor`` for the doctor in any case, ``Patient`` for everyone else."""
    return F.when(_is_doctor(speaker), fv.DOCTOR_LABEL).otherwise(fv.PATIENT_LABEL)


def transcript_line(speaker: Column, text: Column) -> Column:
    """``Label: text``."""
    return F.concat(speaker_label(speaker), F.lit(": "), F.coalesce(text, F.lit("")))


def source_language(speaker: Column) -> Column:
    """C11: language the speaker talks in."""
    return F.when(_is_doctor(speaker), fv.HINDI).otherwise(fv.KANNADA)


def target_language(speaker: Column) -> Column:
    """C11: language of the transcript and of its spoken playback."""
    return F.when(_is_doctor(speaker), fv.KANNADA).otherwise(fv.ENGLISH)


def needs_second_translation(target: Column) -> Column:
    """Speech arrives in English; any other target takes one more step."""
    return target != fv.ENGLISH


def translated_or_original(translated: Column, transcript: Column) -> Column:
    """The translation where there is one."""
    return F.coalesce(translated, transcript)


def stripped(text: Column) -> Column:
    """Text without white space of any script at either end."""
    return F.btrim(text, F.lit(fv.WHITE_SPACE))


def long_enough(text: Column, minimum: int = fv.MIN_CONVERSATION_CHARS) -> Column:
    """More than ``minimum`` characters remain after stripping."""
    return F.coalesce(F.length(stripped(text)) > minimum, F.lit(False))


def keyword_risk(
    text: Column,
    words: tuple[str, ...] = fv.RISK_WORDS,
    hit: float = fv.RISK_SCORE_HIT,
    miss: float = fv.RISK_SCORE_MISS,
) -> Column:
    """``hit`` where the text names any of the words, else ``miss``."""
    pattern = "|".join(re.escape(word.lower()) for word in words)
    return F.when(F.lower(text).rlike(pattern), F.lit(hit)).otherwise(F.lit(miss))


def is_leak(score: Column, threshold: float = 0.5) -> Column:
    """our reading of the flag, which the stored data leaves open."""
    return score >= threshold
