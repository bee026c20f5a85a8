"""Document ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.transcript import stripped


def document_id(prefix: str, at: Column, *content: Column) -> Column:
    """``<prefix><unix seconds>-<8 hex digits of the content>``.

    The digits tell apart documents of one second. The id depends on the row
    alone, so a retried task writes the id its first attempt wrote.
    """
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    seconds = F.unix_seconds(at.cast("timestamp")).cast("string")
    return F.concat(F.lit(prefix), seconds, F.lit("-"), F.substring(digest, 1, 8))


def file_stamp(at: Column) -> Column:
    """``YYYYmmdd_HHMMSS``."""
    return F.date_format(at, fv.FILE_STAMP)


def normalise_id(value: Column, upper: bool = True) -> Column:
    """trimmed and, unless told otherwise, upper-case id."""
    trimmed = stripped(value)
    return F.upper(trimmed) if upper else trimmed


def attachment_path(patient_id: Column, date: Column, file_name: Column) -> Column:
    """relative path of an attachment, null without a file.

    A leading dot starts a hidden file's name and no extension.
    """
    base = F.regexp_extract(file_name, r"([^/]*)$", 1)
    extension = F.regexp_extract(base, r"[^.].*(\.[^.]*)$", 1)
    path = F.concat(
        F.lit(f"{fv.ATTACHMENT_FOLDER}/lab_"), patient_id, F.lit("_"), date, extension
    )
    return F.when(file_name.isNotNull(), path)


def is_audio_file(file_name: Column) -> Column:
    """Name ends with an audio extension; case counts."""
    endings = "|".join(ext.lstrip(".") for ext in fv.AUDIO_EXTENSIONS)
    return file_name.rlike(rf"\.({endings})$")
