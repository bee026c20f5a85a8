"""The given tables in the shape of the documents the engine works on.

Each frame has a SQL twin of the same name, for use as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook import fixed_values as fv

STATUS_OF_EVENT = {
    "purchase": fv.STATUS_PENDING_PHARMACY,
    "view": fv.STATUS_DISPENSED,
    "click": "pending",
    "signup": "completed",
    "error": fv.STATUS_FULFILLED,
}
STATUS_OF_ORDER = {
    "O": fv.REQUEST_PENDING,
    "F": fv.REQUEST_COMPLETED,
    "P": "Pending Laboratory",
}
SPEAKER_OF_ROLE = {"assistant": "DOCTOR", "user": "patient", "system": "system"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _case(column: Column, mapping: dict[str, str]) -> Column:
    pairs = iter(mapping.items())
    key, value = next(pairs)
    chosen = F.when(column == key, value)
    for key, value in pairs:
        chosen = chosen.when(column == key, value)
    return chosen


def _case_sql(column: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} END"


def iso(ts: str) -> Column:
    return F.date_format(ts, fv.ISO_MICROS)


def iso_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as clinical records, with the event id."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("patient_id"),
        F.array(kind).alias("symptoms"),
        F.when(kind == "view", "").when(kind != "error", kind).alias("diagnosis"),
        F.when(kind == "purchase", F.col("props")).alias("medication"),
        F.when(kind != "click", F.lit("")).alias("dosage"),
        F.when(kind != "signup", F.array(F.concat(kind, F.lit(" panel")))).alias("lab_tests"),
        F.col("props").alias("raw_transcript"),
        iso("ts").alias("timestamp"),
        _case(kind, STATUS_OF_EVENT).alias("status"),
        F.when(kind == "purchase", fv.PHARMACY_PENDING).alias("pharmacy_status"),
    )


RECORDS = f"""records AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS patient_id, [event_type] AS symptoms,
    CASE WHEN event_type = 'view' THEN '' WHEN event_type <> 'error' THEN event_type END AS diagnosis,
    CASE WHEN event_type = 'purchase' THEN props END AS medication,
    CASE WHEN event_type <> 'click' THEN '' END AS dosage,
    CASE WHEN event_type <> 'signup' THEN [event_type || ' panel'] END AS lab_tests,
    props AS raw_transcript, {iso_sql("ts")} AS "timestamp",
    {_case_sql("event_type", STATUS_OF_EVENT)} AS status,
    CASE WHEN event_type = 'purchase' THEN '{fv.PHARMACY_PENDING}' END AS pharmacy_status
  FROM events)"""


def lab_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as lab requests."""
    status = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("REQ-"), F.col("o_orderkey").cast("string")).alias("request_id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.col("o_orderpriority").alias("test_type"),
        F.when(status != "F", F.lit(fv.DEFAULT_REQUESTER)).alias("requested_by"),
        F.date_format("o_orderdate", fv.CALENDAR_DATE).alias("date"),
        _case(status, STATUS_OF_ORDER).alias("status"),
    )


LAB_REQUESTS = f"""lab_requests AS (
  SELECT 'REQ-' || o_orderkey AS request_id, CAST(o_custkey AS VARCHAR) AS patient_id,
    o_orderpriority AS test_type,
    CASE WHEN o_orderstatus <> 'F' THEN '{fv.DEFAULT_REQUESTER}' END AS requested_by,
    strftime(o_orderdate, '%Y-%m-%d') AS date,
    {_case_sql("o_orderstatus", STATUS_OF_ORDER)} AS status
  FROM orders)"""


def lab_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as lab reports of one to three tests."""
    quantity, discount, tax = (F.col(f"l_{c}") for c in ("quantity", "discount", "tax"))

    def test(name: str, value: Column, normal: str, status: Column) -> Column:
        return F.struct(
            F.lit(name).alias("test_name"),
            value.cast("string").alias("value"),
            F.lit(normal).alias("normal_range"),
            status.alias("status"),
        )

    by_quantity = F.when(quantity > 40, "HIGH").when(quantity < 10, "LOW").otherwise("NORMAL")
    by_discount = F.when(discount > 0.08, "FAIL").otherwise("NORMAL")
    by_tax = F.when(tax == 0, "VOID").otherwise("NORMAL")
    tests = F.array(
        test("quantity", quantity, "10-40", by_quantity),
        test("discount", discount, "<0.08", by_discount),
        test("tax", tax, ">0", by_tax),
    )
    size = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "-", F.lit("LAB"), *(f"l_{c}" for c in ("orderkey", "linenumber", "partkey", "suppkey"))
        ).alias("report_id"),
        F.col("l_suppkey").cast("string").alias("patient_id"),
        F.col("l_linestatus").alias("report_type"),
        F.date_format("l_shipdate", fv.CALENDAR_DATE).alias("date"),
        F.lit(None).cast("string").alias("file_path"),
        F.slice(tests, 1, size).alias("lab_tests"),
        F.when(
            F.col("l_returnflag") == "R", F.concat(F.lit("REQ-"), F.col("l_orderkey").cast("string"))
        ).alias("request_id"),
    )


LAB_REPORTS = """lab_reports AS (
  SELECT concat_ws('-', 'LAB', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS report_id,
    CAST(l_suppkey AS VARCHAR) AS patient_id, l_linestatus AS report_type,
    strftime(l_shipdate, '%Y-%m-%d') AS date, CAST(NULL AS VARCHAR) AS file_path,
    [{'test_name': 'quantity', 'value': CAST(l_quantity AS VARCHAR), 'normal_range': '10-40',
      'status': CASE WHEN l_quantity > 40 THEN 'HIGH' WHEN l_quantity < 10 THEN 'LOW' ELSE 'NORMAL' END},
     {'test_name': 'discount', 'value': CAST(l_discount AS VARCHAR), 'normal_range': '<0.08',
      'status': CASE WHEN l_discount > 0.08 THEN 'FAIL' ELSE 'NORMAL' END},
     {'test_name': 'tax', 'value': CAST(l_tax AS VARCHAR), 'normal_range': '>0',
      'status': CASE WHEN l_tax = 0 THEN 'VOID' ELSE 'NORMAL' END}
    ][1:CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END] AS lab_tests,
    CASE WHEN l_returnflag = 'R' THEN 'REQ-' || l_orderkey END AS request_id
  FROM lineitem)"""


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as transcript lines."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("consult_id"),
        "turn",
        _case(F.col("role"), SPEAKER_OF_ROLE).alias("speaker"),
        "text",
    )


TRANSCRIPT_LINES = f"""transcript_lines AS (
  SELECT CAST(conv_id AS VARCHAR) AS consult_id, turn,
    {_case_sql("role", SPEAKER_OF_ROLE)} AS speaker, text
  FROM conversations)"""

# F14, F15 and A4 in SQL, from transcript_lines.
CONVERSATIONS = """spoken AS (
  SELECT consult_id, turn, CASE WHEN lower(speaker) = 'doctor' THEN 'Doctor' ELSE 'Patient' END
    || ': ' || text AS line
  FROM transcript_lines),
consultations AS (
  SELECT consult_id, string_agg(line, chr(10) ORDER BY turn, line) AS conversation
  FROM spoken GROUP BY consult_id)"""

# W1, C3 and F11 in SQL, from records; each record has one symptom.
HISTORY = """visits AS (
  SELECT patient_id, "timestamp" AS date, coalesce(diagnosis, 'N/A') AS diagnosis,
    coalesce(medication, 'N/A') AS medication, symptoms[1] AS symptom,
    row_number() OVER (PARTITION BY patient_id ORDER BY "timestamp" DESC) AS rank
  FROM records),
history AS (
  SELECT patient_id, '[' || chr(10) || '  ' || string_agg(
      '{' || chr(10) || '    "date": ' || to_json(date) || ',' || chr(10)
      || '    "diagnosis": ' || to_json(diagnosis) || ',' || chr(10)
      || '    "medication": ' || to_json(medication) || ',' || chr(10)
      || '    "symptoms": [' || chr(10) || '      ' || to_json(symptom) || chr(10)
      || '    ]' || chr(10) || '  }', ',' || chr(10) || '  ' ORDER BY rank)
    || chr(10) || ']' AS history
  FROM visits WHERE rank <= 3 GROUP BY patient_id)"""


def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
