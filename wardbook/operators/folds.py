"""Folding transcript lines into conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_TURNS = 1024


def _joined(position: str, text: str) -> Column:
    """Texts of a group in order of position; equal positions order by the text."""
    ordered = F.array_sort(F.collect_list(F.struct(position, text)))
    return F.array_join(F.transform(ordered, lambda row: row[text]), "\n")


def conversation_segments(
    lines: DataFrame,
    consult: str = "consult_id",
    turn: str = "turn",
    line: str = "line",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """A4, by stretches of turns: ``(consult, segment, conversation)``.

    Grouping by stretch bounds what a task holds, however long a consultation
    is. In segment order, the texts are the whole conversation.
    """
    segment = F.floor(F.col(turn) / segment_turns).alias("segment")
    return lines.groupBy(consult, segment).agg(_joined(turn, line).alias("conversation"))


def fold_conversations(
    lines: DataFrame,
    consult: str = "consult_id",
    turn: str = "turn",
    line: str = "line",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """A4: one row per consultation, its lines joined by line breaks in turn order.

    Lines are sorted and joined per stretch of turns, and only the finished
    stretches meet in one group. The result is one cell, which Spark holds up to
    2 GB; read a longer consultation as ``conversation_segments``.
    """
    segments = conversation_segments(lines, consult, turn, line, segment_turns)
    return segments.groupBy(consult).agg(
        _joined("segment", "conversation").alias("conversation")
    )
