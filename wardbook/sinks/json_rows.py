"""K5: rows as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardbook.functions.json_text import json_row


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, null fields included."""
    return df.select(json_row(*df.columns).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """The same as files of JSON lines."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
