"""Approved records from the landing folder into the audit table, as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardbook.operators.counts import counted, has_rows
from wardbook.operators.filters import with_transcript
from wardbook.sinks.table import append_to_table, with_audit_columns


def records_to_commit(landing: DataFrame) -> DataFrame:
    """Landing records in the form the audit table takes."""
    return with_audit_columns(with_transcript(landing))


def commit_landing(landing: DataFrame, table: str) -> int:
    """Append a landing folder and return the row count.

    Appends whatever it is given; ``streaming.ingest`` is the form that takes
    each document once. Errors propagate, and the count comes from the write.
    """
    rows = records_to_commit(landing)
    if not has_rows(rows):
        return 0
    observed, seen = counted(rows)
    append_to_table(observed, table)
    return seen.get["rows"]
