"""Scans of JSON document folders.

``layout`` tells how files store their documents. ``"lines"``, the default of every reader
and of ``land``, is one object or array of objects per line; such files can be split, and the
scan is lazy. A document over several lines is damaged there. ``"auto"`` finds the layout of
each file: a file that is one JSON value as a whole is read as that, any other by its lines, so
a folder may mix both and nothing is lost. It reads files with a line that is no JSON a second
time, and it looks for them when the scan is made. ``"document"`` is another word for it.
Sub-folders are other collections and are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardbook import schemas
from wardbook.functions.json_text import parsed_object

CORRUPT = "_corrupt_record"
# Not a name that a document's field has.
FILE = "_file_path"
LAYOUTS = ("auto", "document", "lines")
#: Plain and compressed files.
DOCUMENT_FILES = "*{.json,.json.gz}"
#: Bytes of the largest file that may be one document; a cell takes no more than twice that.
LARGEST_DOCUMENT = 2**30
#: The same of a compressed file, which holds up to 1,032 times its bytes.
LARGEST_PACKED = LARGEST_DOCUMENT // 1032


def reader_options(whole: bool = False, files: str = DOCUMENT_FILES) -> dict[str, str]:
    """Options every JSON scan shares, batch or stream."""
    return {
        "mode": "PERMISSIVE",
        "multiLine": str(whole).lower(),
        "pathGlobFilter": files,
        # Not JSON, although Spark would take it by default.
        "allowSingleQuotes": "false",
    }


def checked_layout(layout: str) -> bool:
    """Whether files are to be looked into; unknown names are refused."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    return layout != "lines"


def as_paths(file_paths: Sequence[str]) -> list[str]:
    """What ``_metadata.file_path`` says, as paths to read: decoded, and no patterns."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path)) for path in file_paths]


def with_corrupt(schema: StructType) -> StructType:
    """The schema with room for the text of a document the reader stumbled over."""
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


def is_damaged() -> Column:
    """Whether the text is no JSON object or array, rather than one with a field of another type."""
    text = F.col(CORRUPT)
    document = text.rlike(r"^\s*[\[{]") & parsed_object(text).isNotNull()
    return text.isNotNull() & ~document


def whole_documents(spark: SparkSession, suspects: DataFrame) -> list[str]:
    """Those files of ``suspects`` (``FILE``) that are one JSON value as a whole.

    The names go to the driver, which lists all files of a folder anyway. The JSON reader
    would stop after the first value, so text behind it is looked for.
    """
    names = [r[FILE] for r in suspects.select(FILE).distinct().collect()]
    if not names:
        return []
    place = F.col("_metadata.file_path")
    most = F.when(place.endswith(".gz"), LARGEST_PACKED).otherwise(LARGEST_DOCUMENT)
    sized = spark.read.format("binaryFile").load(as_paths(names)).where(F.col("length") <= most)
    small = [r[FILE] for r in sized.select(place.alias(FILE)).collect()]
    if not small:
        return []
    texts = spark.read.text(as_paths(small), wholetext=True)
    one = texts.where(parsed_object(F.col("value")).isNotNull())
    return [r[FILE] for r in one.select(place.alias(FILE)).collect()]


def _lines(
    spark: SparkSession, paths: str | list[str], schema: StructType, whole: bool, files: str
) -> DataFrame:
    """Documents with their ``FILE`` and, where they cannot be read, their text."""
    reader = spark.read.schema(with_corrupt(schema)).options(**reader_options(whole, files))
    rows = reader.option("columnNameOfCorruptRecord", CORRUPT).json(paths)
    # Always true. The reader refuses a plan that needs the corrupt text alone,
    # as a count of the bad documents would, so a second column is kept in use.
    rows = rows.filter(F.length(F.concat_ws("", schema.names[0])) >= 0)
    return rows.select("*", F.col("_metadata.file_path").alias(FILE))


def documents_of_files(
    spark: SparkSession, names: list[str], schema: StructType, files: str = DOCUMENT_FILES
) -> DataFrame:
    """The documents of files that are one JSON value each, in the form of ``with_file``."""
    return _lines(spark, as_paths(names), schema, True, files)


def with_file(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    layout: str = "lines",
    files: str = DOCUMENT_FILES,
) -> DataFrame:
    """Documents with their ``FILE`` and the text of those that cannot be read."""
    rows = _lines(spark, path, schema, False, files)
    if not checked_layout(layout):
        return rows
    return routed(spark, rows, whole_documents(spark, rows.where(is_damaged())), schema, files)


def routed(
    spark: SparkSession, lines: DataFrame, whole: list[str], schema: StructType, files: str
) -> DataFrame:
    """The rows of ``lines``, but of the files in ``whole`` the documents they are."""
    if not whole:
        return lines
    # Lines of these files are never parsed: a filter on file names prunes the listing.
    rest = lines.where(~F.col(FILE).isin(whole))
    return rest.unionByName(documents_of_files(spark, whole, schema, files))


def scan_documents(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    layout: str = "lines",
    files: str = DOCUMENT_FILES,
) -> DataFrame:
    """Documents under an explicit schema, absent fields as null.

    A document that cannot be read gives one row of nulls; ``readable`` leaves it out
    and ``quarantine`` keeps its text. A field of another type than the schema's is null.
    """
    if checked_layout(layout):
        return with_file(spark, path, schema, layout, files).select(*schema.names)
    return spark.read.schema(schema).options(**reader_options(False, files)).json(path)


def scan_clinical(
    spark: SparkSession, path: str | list[str], layout: str = "lines"
) -> DataFrame:
    """Clinical records, with every field a record may hold."""
    return scan_documents(spark, path, schemas.CLINICAL_RECORD, layout)


def scan_lab_reports(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Lab reports; unreadable documents, which have no id, are left out."""
    return readable(spark, path, schemas.LAB_REPORT, layout)


def scan_lab_requests(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """S3: lab requests; unreadable documents are left out."""
    return readable(spark, path, schemas.LAB_REQUEST, layout)


def scan_goods_receipts(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Goods-receipt voice logs."""
    return scan_documents(spark, path, schemas.GOODS_RECEIPT_LOG, layout)


def scan_union_of_keys(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """S5, opt-in: the schema is the union of all keys, at the price of a full first read."""
    if not checked_layout(layout):
        return spark.read.options(**reader_options()).json(path)
    lines = _lines(spark, path, StructType([StructField("any", StringType())]), False, DOCUMENT_FILES)
    whole = whole_documents(spark, lines.where(is_damaged()))
    every = spark.read.format("binaryFile").option("pathGlobFilter", DOCUMENT_FILES).load(path)
    names = [r[0] for r in every.select("_metadata.file_path").collect()]
    parts = [(False, [n for n in names if n not in set(whole)]), (True, whole)]
    read = [
        spark.read.options(**reader_options(one)).json(as_paths(own)) for one, own in parts if own
    ]
    return read[0] if len(read) == 1 else read[0].unionByName(read[1], allowMissingColumns=True)


def readable(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    layout: str = "lines",
    files: str = DOCUMENT_FILES,
) -> DataFrame:
    """The documents that can be read."""
    rows = with_file(spark, path, schema, layout, files)
    return rows.filter(~is_damaged()).select(*schema.names)


def quarantine(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    layout: str = "lines",
    files: str = DOCUMENT_FILES,
) -> DataFrame:
    """File and text of every document that cannot be read."""
    rows = with_file(spark, path, schema, layout, files)
    return rows.filter(is_damaged()).select(F.col(FILE).alias("file_path"), F.col(CORRUPT).alias("document"))
