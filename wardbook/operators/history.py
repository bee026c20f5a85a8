"""Patient history and the patient's bundle of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.json_text import indented_visits, json_row
from wardbook.operators.dedup import last_visits, row_digest, union_widened
from wardbook.operators.keyed import left_join_unique, rows_with_keys


def visit_columns(records: DataFrame) -> DataFrame:
    """Patient, date, diagnosis, medication, symptoms, with their defaults."""

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    return records.select(
        "patient_id",
        text("timestamp", fv.HISTORY_DATE_DEFAULT).alias("date"),
        text("diagnosis", fv.HISTORY_TEXT_DEFAULT).alias("diagnosis"),
        text("medication", fv.HISTORY_TEXT_DEFAULT).alias("medication"),
        F.coalesce("symptoms", F.array().cast("array<string>")).alias("symptoms"),
    )


def patient_history(
    records: DataFrame,
    patients: DataFrame | None = None,
    visits: int = fv.HISTORY_VISITS,
    indented: bool = True,
) -> DataFrame:
    """``(patient_id, history)``, the last visits as JSON text.

    Dates compare as text, so a visit without one ranks first, and at most
    ``visits`` rows per patient are ever gathered. With ``patients``, only theirs
    are made: worth it where they are few, since the records of all others then
    drop out before they are sorted.
    """
    rows = visit_columns(records.filter(F.col("patient_id").isNotNull()))
    if patients is not None:
        rows = rows_with_keys(rows, patients, ["patient_id"])
    return history_of(rows, visits, indented)


def history_of(
    rows: DataFrame, visits: int = fv.HISTORY_VISITS, indented: bool = True
) -> DataFrame:
    """``(patient_id, history)`` from the columns of visits."""
    tie = row_digest(rows, ("patient_id",))
    last = last_visits(rows, "patient_id", F.col("date"), [tie], visits, rank_as="rank")
    visit = F.struct("date", "diagnosis", "medication", "symptoms").alias("visit")
    ranked = F.array_sort(F.collect_list(F.struct("rank", visit)))
    listed = F.transform(ranked, lambda row: row["visit"])
    history = indented_visits(listed) if indented else F.to_json(listed)
    return last.groupBy("patient_id").agg(history.alias("history"))


def attach_history(conversations: DataFrame, history: DataFrame) -> DataFrame:
    """Each conversation with its patient's history text."""
    joined = left_join_unique(conversations, history, ["patient_id"])
    return joined.withColumn("history", F.coalesce("history", F.lit(fv.NO_HISTORY)))


def patient_bundle(records: DataFrame, reports: DataFrame) -> DataFrame:
    """Records and lab reports of every patient side by side, one document a row.

    Kept long on purpose: the documents of one patient have no size limit, and a
    filter on ``patient_id`` reaches both scans.
    """

    def entries(df: DataFrame, kind: str, when: str) -> DataFrame:
        return df.select(
            "patient_id",
            F.lit(kind).alias("kind"),
            F.col(when).alias("at"),
            json_row(*(c for c in df.columns if c != "patient_id")).alias("document"),
        )

    return union_widened(entries(records, "record", "timestamp"), entries(reports, "lab_report", "date"))


def patient_overview(records: DataFrame, reports: DataFrame) -> DataFrame:
    """Per patient, how many records and reports there are and when the last came."""

    def summary(df: DataFrame, when: str, count: str, last: str) -> DataFrame:
        return (
            df.filter(F.col("patient_id").isNotNull())
            .groupBy("patient_id")
            .agg(F.count(F.lit(1)).alias(count), F.max(when).alias(last))
        )

    both = summary(records, "timestamp", "records", "last_record").join(
        summary(reports, "date", "lab_reports", "last_report"), "patient_id", "full_outer"
    )
    return both.fillna(0, ["records", "lab_reports"])
