"""Defaults, buckets and flags that the screens derive from a record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from wardbook import fixed_values as fv


def text_or(value: Column, default: str) -> Column:
    """The value, or the default where it is null or the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def with_text_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Apply ``text_or`` to each named column that the frame has."""
    present = {name: text for name, text in defaults.items() if name in df.columns}
    return df.withColumns({n: text_or(F.col(n), t) for n, t in present.items()})


def dashboard_rows(df: DataFrame) -> DataFrame:
    """One dashboard line per record."""
    return with_text_defaults(df, fv.DASHBOARD_DEFAULTS).withColumn(
        "status_bucket", status_bucket(F.col("status"))
    )


def pharmacy_cards(df: DataFrame) -> DataFrame:
    """One pharmacy card per record."""
    return with_text_defaults(df, fv.PHARMACY_DEFAULTS)


def timeline_entries(df: DataFrame, accept_dispensed: bool = False) -> DataFrame:
    """One patient-timeline entry per record."""
    return with_text_defaults(df, fv.TIMELINE_DEFAULTS).withColumns(
        {
            "medication_state": fulfilment_label(F.col("status"), accept_dispensed),
            "has_symptoms": has_items(F.col("symptoms")),
            "has_lab_tests": has_items(F.col("lab_tests")),
        }
    )


def status_contains(status: Column, *words: str) -> Column:
    """P10: status holds any of the words."""
    return reduce(Column.__or__, [status.contains(word) for word in words])


def status_bucket(status: Column) -> Column:
    """``pending`` before ``completed``; any other status is its own bucket."""
    return (
        F.when(status_contains(status, "pending"), "pending")
        .when(status_contains(status, "completed", "dispensed"), "completed")
        .otherwise(status)
    )


def fulfilment_label(status: Column, accept_dispensed: bool = False) -> Column:
    """Label of a fulfilled or still open prescription."""
    done = [fv.STATUS_FULFILLED]
    if accept_dispensed:
        done.append(fv.STATUS_DISPENSED)
    return F.when(status.isin(done), fv.DISPENSED_LABEL).otherwise(fv.NOT_DISPENSED_LABEL)


def nan_to_null(df: DataFrame) -> DataFrame:
    """C4: NaN becomes null; only floating columns can hold it."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))
    ]
    if not floating:
        return df
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floating})


def has_items(values: Column) -> Column:
    """A5: array is there and not empty."""
    return F.coalesce(F.size(values) > 0, F.lit(False))
