"""Time columns. Session time zone is UTC, as are the documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardbook import fixed_values as fv


def parse_timestamp(text: Column) -> Column:
    """ISO text to timestamp, anything else to null.

    Text without a leading year is refused, because Spark would complete a bare
    time of day with the current date and a replay would give another result.
    """
    return F.when(text.rlike(r"^\s*\d{4}"), F.try_to_timestamp(text))


def to_seconds_text(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``; null stays null."""
    return F.date_format(ts, fv.SECONDS)


def to_second(ts: Column) -> Column:
    """The instant F2 prints, still as a timestamp: eight bytes as a shuffle key."""
    return F.date_trunc("second", ts)


def utc_stamp(at: Column | None = None) -> Column:
    """UTC ISO text with microseconds and no zone."""
    return F.date_format(F.current_timestamp() if at is None else at, fv.ISO_MICROS)


def calendar_date(ts: Column) -> Column:
    """``YYYY-MM-DD`` text."""
    return F.date_format(ts, fv.CALENDAR_DATE)


def first_token(text: Column) -> Column:
    """F16: text up to the first white space, null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(\S+)", 1), F.lit(""))


def display_date(ts: Column) -> Column:
    """for example ``Mar 4, 2026``."""
    return F.date_format(ts, fv.DISPLAY_DATE)


def display_time(ts: Column) -> Column:
    """for example ``09:05 AM``."""
    return F.date_format(ts, fv.DISPLAY_TIME)
