"""Writes to the landing folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook import schemas
from wardbook.functions.ids import attachment_path, document_id
from wardbook.functions.lab import parse_tests
from wardbook.functions.timestamps import calendar_date, utc_stamp


def approved_records(drafts: DataFrame, at: Column | None = None) -> DataFrame:
    """K2: drafts as clinical records that wait for the pharmacy.

    ``at`` is the approval time, the current time unless given.
    """
    stamped = drafts.withColumns(
        {
            "timestamp": utc_stamp(at),
            "status": F.lit(fv.STATUS_PENDING_PHARMACY),
            "pharmacy_status": F.lit(fv.PHARMACY_PENDING),
        }
    )
    return stamped.select(*schemas.CLINICAL_RECORD.names)


def lab_reports_from(uploads: DataFrame, at: Column | None = None) -> DataFrame:
    """K3: uploads (patient_id, report_type, lab_tests as JSON text, request_id,
    file_name) as lab reports."""
    now = F.current_timestamp() if at is None else at
    date = calendar_date(now)
    content = [F.col(c) for c in ("patient_id", "report_type", "lab_tests", "request_id")]
    return uploads.select(
        document_id(fv.REPORT_ID_PREFIX, now, *content).alias("report_id"),
        "patient_id",
        "report_type",
        date.alias("date"),
        attachment_path(F.col("patient_id"), date, F.col("file_name")).alias("file_path"),
        parse_tests(F.col("lab_tests")).alias("lab_tests"),
        "request_id",
    )


def lab_requests_from(orders: DataFrame, at: Column | None = None) -> DataFrame:
    """K4: orders (patient_id, test_type, requested_by) as pending lab requests."""
    now = F.current_timestamp() if at is None else at
    content = [F.col(c) for c in ("patient_id", "test_type", "requested_by")]
    return orders.select(
        document_id(fv.REQUEST_ID_PREFIX, now, *content).alias("request_id"),
        "patient_id",
        "test_type",
        F.coalesce("requested_by", F.lit(fv.DEFAULT_REQUESTER)).alias("requested_by"),
        calendar_date(now).alias("date"),
        F.lit(fv.REQUEST_PENDING).alias("status"),
    )


def dispense_events(requests: DataFrame, at: Column | None = None) -> DataFrame:
    """Dispense requests (patient_id, timestamp) as status events of now."""
    return requests.select(
        "patient_id",
        "timestamp",
        F.lit(None).cast("string").alias("raw_transcript"),
        F.lit(fv.STATUS_DISPENSED).alias("status"),
        utc_stamp(at).alias("event_time"),
    )


def update_events(requests: DataFrame, at: Column | None = None) -> DataFrame:
    """Update requests (timestamp, raw_transcript, status) as status events of now."""
    return requests.select(
        F.lit(None).cast("string").alias("patient_id"),
        "timestamp",
        "raw_transcript",
        "status",
        utc_stamp(at).alias("event_time"),
    )


#: Documents of one compressed file, which is read by one task.
PACKED_DOCUMENTS = 500_000


def land(
    documents: DataFrame, path: str, one_per_file: bool = False, compressed: bool = False
) -> None:
    """Append documents to a landing folder, null fields included.

    Files hold one document per line (layout ``lines``) unless ``one_per_file``
    asks for the ``document`` layout, which suits small landings only. ``compressed`` files
    end in ``.json.gz`` and take a tenth of the room; they hold ``PACKED_DOCUMENTS`` at most.
    """
    writer = documents.write.mode("append").option("ignoreNullFields", "false")
    if compressed:
        writer = writer.option("maxRecordsPerFile", PACKED_DOCUMENTS)
        writer = writer.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"})
    if one_per_file:
        writer = writer.option("maxRecordsPerFile", 1)
    writer.json(path)
