"""Lab requests and reports as tables that outlive their landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardbook import schemas
from wardbook.sinks.table import write_batch
from wardbook.sources.table import scan_partitions
from wardbook.streaming.ingest import ingest_documents

# Schema and the column without which a document is none, by the kind of document.
KINDS: dict[str, tuple[StructType, str]] = {
    "reports": (schemas.LAB_REPORT, "report_id"),
    "requests": (schemas.LAB_REQUEST, "request_id"),
}
#: Columns by which documents are looked up.
LOOKUPS = ("patient_id", "request_id")
#: Days that lie together; a patient's documents are spread over years.
PERIOD = "month"


def ingest_lab(
    spark: SparkSession, kind: str, landing: str, table: str, checkpoint: str, **options
) -> StreamingQuery:
    """Lab documents of a kind into a table, each once, as ``ingest_folder`` does.

    They lie by month, in a file by patient, with filters on patient and request, so that a
    lookup skips most row groups. What is ingested stays when the folder is emptied.
    """
    schema, needed = KINDS[kind]

    def commit(good: DataFrame, name: str) -> None:
        write_batch(good, table, name, schema, LOOKUPS, PERIOD)

    return ingest_documents(spark, landing, table, checkpoint, schema, needed, commit, **options)


def scan_lab(
    spark: SparkSession, kind: str, table: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """P5: the documents of such a table; filters on patient and request reach its files.

    ``since`` and ``until`` (``YYYY-MM-DD``, both included) read the months of those days only.
    """
    schema, _ = KINDS[kind]
    first = None if since is None else f"{since[:7]}-01"
    rows = scan_partitions(spark, table, schema, first, until)
    if since is not None:
        rows = rows.filter(F.col("date") >= since)
    if until is not None:
        rows = rows.filter(F.col("date") <= until)
    return rows.select(*schema.names)
