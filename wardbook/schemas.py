"""Schemas of the documents and tables."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _texts(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


def _text_list(name: str) -> StructField:
    return StructField(name, ArrayType(StringType()))


CLINICAL_RECORD = StructType(
    [
        *_texts("patient_id"),
        _text_list("symptoms"),
        *_texts("diagnosis", "medication", "dosage"),
        _text_list("lab_tests"),
        *_texts("raw_transcript", "timestamp", "status", "pharmacy_status"),
    ]
)

LAB_TEST = StructType(_texts("test_name", "value", "normal_range", "status"))

LAB_REPORT = StructType(
    [
        *_texts("report_id", "patient_id", "report_type", "date", "file_path"),
        StructField("lab_tests", ArrayType(LAB_TEST)),
        *_texts("request_id"),
    ]
)

LAB_REQUEST = StructType(
    _texts("request_id", "patient_id", "test_type", "requested_by", "date", "status")
)

GOODS_RECEIPT_LOG = StructType(_texts("timestamp", "raw_transcript", "status"))

AUDIT_COLUMNS = [
    StructField("is_leak", BooleanType()),
    StructField("risk_score", DoubleType()),
]

# The oldest committed form of the audit table; later columns read as null.
AUDIT_RECORD_V0 = StructType([*GOODS_RECEIPT_LOG.fields, *AUDIT_COLUMNS])
AUDIT_RECORD = StructType([*CLINICAL_RECORD.fields, *AUDIT_COLUMNS])
AUDIT_DIGEST = StructField("transcript_digest", StringType())
AUDIT_TABLE = StructType([*AUDIT_RECORD.fields, AUDIT_DIGEST])
AUDIT_PARTITION = StructField("event_date", DateType())

VISIT = StructType([*_texts("patient_id", "date", "diagnosis", "medication"), _text_list("symptoms")])

TRANSCRIPT_LINE = StructType(
    [
        *_texts("consult_id"),
        StructField("turn", LongType()),
        *_texts("speaker", "text"),
    ]
)

STATUS_EVENT = StructType(
    _texts("patient_id", "timestamp", "raw_transcript", "status", "event_time")
)
