"""Row filters. Each is a plain predicate that reaches a Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.ids import is_audio_file
from wardbook.functions.transcript import long_enough


def with_transcript(df: DataFrame) -> DataFrame:
    """Rows that have a transcript."""
    return df.dropna(subset=["raw_transcript"])


def equal_if_given(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Exact match, skipped without a value or without the column."""
    if not value or column not in df.columns:
        return df
    return df.filter(F.col(column) == value)


def pending_requests(requests: DataFrame) -> DataFrame:
    """Lab requests in exactly the pending state."""
    return requests.filter(F.col("status") == fv.REQUEST_PENDING)


def of_patient(df: DataFrame, patient_id: str) -> DataFrame:
    """Rows of one patient."""
    return df.filter(F.col("patient_id") == patient_id)


def extractable(conversations: DataFrame, text: str = "conversation") -> DataFrame:
    """Conversations long enough to be worth a model call."""
    return conversations.filter(long_enough(F.col(text)))


def audio_files(manifest: DataFrame, name: str = "file_name") -> DataFrame:
    """Manifest rows that name an audio file."""
    return manifest.filter(is_audio_file(F.col(name)))
