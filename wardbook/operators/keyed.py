"""Joins and updates by key.

Every update below joins the rows to a side with at most one row per key. The
rows may be skewed without bound (one patient can own a third of them); the
other side is made unique by a partially aggregated ``groupBy`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.functions.timestamps import first_token, parse_timestamp

_KEY_HASH = "__key_hash"


def left_join_unique(rows: DataFrame, unique: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a side that holds one row per key, safe against hot keys.

    Adaptive execution splits a hot partition only when a plain exchange lies
    right below the join on both sides. A side that a ``groupBy`` has already
    partitioned by the key would be joined without one, so the hash of the key
    joins as well: it changes no match and makes both sides exchange. A side
    that turns out small is broadcast instead, on its measured size.
    """
    hashed = F.xxhash64(*keys)
    return (
        rows.withColumn(_KEY_HASH, hashed)
        .join(unique.withColumn(_KEY_HASH, hashed), [*keys, _KEY_HASH], "left")
        .drop(_KEY_HASH)
    )


def rows_with_keys(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Left semi join in the same shape: the rows whose key is among the wanted ones."""
    hashed = F.xxhash64(*keys)
    return (
        rows.withColumn(_KEY_HASH, hashed)
        .join(
            wanted.select(*keys).distinct().withColumn(_KEY_HASH, hashed),
            [*keys, _KEY_HASH],
            "left_semi",
        )
        .drop(_KEY_HASH)
    )


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ``order`` must tell the rows of a key apart.

    The maximum is taken before the shuffle, so a hot key sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    picked = df.groupBy(*keys).agg(newest.alias("__last"))
    return picked.select(*keys, *(F.col("__last")[c].alias(c) for c in rest))


def complete_requests(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """Requests that a report names become completed; unknown ids do nothing."""
    answered = (
        reports.filter(F.col("request_id").isNotNull())
        .groupBy("request_id")
        .agg(F.lit(True).alias("__answered"))
    )
    status = F.when(F.col("__answered"), fv.REQUEST_COMPLETED).otherwise(F.col("status"))
    joined = left_join_unique(requests, answered, ["request_id"])
    return joined.withColumn("status", status).select(*requests.columns)


def match_dispenses(
    records: DataFrame, events: DataFrame, event_time: str | None = None
) -> DataFrame:
    """Records with ``__served`` (a dispense event names the patient) and ``__served_at``.

    With ``event_time``, an event reaches only the records that existed by then,
    which is what folding a log of events at a later time needs.
    """
    at = F.lit(None).cast("timestamp")
    named = events.filter(F.col("patient_id").isNotNull())
    if event_time is not None:
        at = parse_timestamp(F.col(event_time))
        named = named.filter(at.isNotNull())
    served = named.groupBy("patient_id").agg(
        F.lit(True).alias("__served"), F.max(at).alias("__served_at")
    )
    joined = left_join_unique(records, served, ["patient_id"])
    hit = F.col("__served")
    if event_time is not None:
        hit = hit & _existed(F.col("timestamp"), F.col("__served_at"))
    return joined.withColumn("__served", F.coalesce(hit, F.lit(False)))


def _existed(record_time: Column, event_time: Column) -> Column:
    """The record is no younger than the event; an undated record counts as old."""
    written = parse_timestamp(record_time)
    return event_time.isNotNull() & (written.isNull() | (written <= event_time))


def dispense(records: DataFrame, events: DataFrame, event_time: str | None = None) -> DataFrame:
    """Every record of a patient named by a dispense event becomes dispensed.

    The timestamp an event carries plays no part in the match.
    """
    matched = match_dispenses(records, events, event_time)

    def updated(name: str) -> Column:
        return F.when(F.col("__served"), fv.STATUS_DISPENSED).otherwise(F.col(name))

    states = [c for c in ("status", "pharmacy_status") if c in records.columns]
    return matched.withColumns({c: updated(c) for c in states}).select(*records.columns)


def unmatched_events(events: DataFrame, records: DataFrame) -> DataFrame:
    """Patients of dispense events that own no record."""
    asked = events.select("patient_id").filter("patient_id is not null").distinct()
    known = records.select("patient_id").distinct()
    return asked.join(known, "patient_id", "left_anti")


def transcript_key(rows: DataFrame) -> Column:
    """SHA-256 of the transcript; rows that were stored with it are not hashed again."""
    hashed = F.sha2("raw_transcript", 256)
    stored = "transcript_digest"
    return F.coalesce(F.col(stored), hashed) if stored in rows.columns else hashed


def match_updates(
    records: DataFrame, events: DataFrame, order: list[str], event_time: str | None = None
) -> DataFrame:
    """Records with ``__status`` and ``__order`` of the latest event that matches.

    A record matches when its transcript equals the event's and its timestamp
    text contains the event's first token, taken literally. ``order`` ranks the
    events; both columns are null on a record that none of them matches. With
    ``event_time``, the first column of ``order``, an event reaches only the
    records that existed by then.

    Containment is turned into equality, so that no group of equal transcripts is
    ever paired up: for each transcript the token lengths in use are known (a set
    of small numbers), a stamp is cut into its pieces of those lengths, and the
    pieces are matched by equality. A token that starts with a full date can only
    sit at the start of a stamp with no date further on, which leaves one piece per
    stamp in the usual case. Transcripts travel as SHA-256 digests.
    """
    day = r"\d{4}-\d{2}-\d{2}"
    # One latest status per transcript and token.
    tokens = last_per_key(
        events.select(
            transcript_key(events).alias("__text"),
            first_token(F.col("timestamp")).alias("__token"),
            F.col("status").alias("__status"),
            F.struct(*order).alias("__order"),
        ).dropna(subset=["__text", "__token"]),
        ["__text", "__token"],
        ["__order"],
    )
    shapes = tokens.groupBy("__text").agg(
        F.collect_set(
            F.struct(
                F.length("__token").alias("size"),
                F.col("__token").rlike("^" + day).alias("dated"),
            )
        ).alias("__shapes")
    )
    stamps = records.select(
        transcript_key(records).alias("__text"), F.col("timestamp").alias("__stamp")
    ).dropna()
    later_date = F.col("__stamp").substr(F.lit(2), F.length("__stamp")).rlike(day)

    def pieces(shape: Column) -> Column:
        last = F.length("__stamp") - shape["size"] + 1
        anchored = shape["dated"] & ~later_date
        starts = F.when(last < 1, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(1), F.when(anchored, 1).otherwise(last))
        )
        return F.transform(starts, lambda at: F.col("__stamp").substr(at, shape["size"]))

    cut = left_join_unique(stamps, shapes, ["__text"]).filter(F.col("__shapes").isNotNull())
    cut = cut.select(
        "__text",
        "__stamp",
        F.explode(F.array_distinct(F.flatten(F.transform("__shapes", pieces)))).alias("__token"),
    )
    matched = left_join_unique(cut, tokens, ["__text", "__token"]).filter(
        F.col("__order").isNotNull()
    )
    if event_time is not None:
        matched = matched.filter(_existed(F.col("__stamp"), F.col("__order")[event_time]))
    latest = last_per_key(
        matched.select("__text", "__stamp", "__status", "__order"),
        ["__text", "__stamp"],
        ["__order"],
    )
    return left_join_unique(
        records.withColumns({"__text": transcript_key(records), "__stamp": F.col("timestamp")}),
        latest,
        ["__text", "__stamp"],
    ).drop("__text", "__stamp")


def update_status(records: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """The latest event that matches a record sets its status."""
    matched = match_updates(records, events, order)
    status = F.when(F.col("__order").isNull(), F.col("status")).otherwise(F.col("__status"))
    return matched.withColumn("status", status).select(*records.columns)


def attach_analyses(reports: DataFrame, analyses: DataFrame, order: list[str]) -> DataFrame:
    """Each report with its latest analysis, null columns where there is none."""
    latest = last_per_key(analyses, ["report_id"], order).drop(*order)
    return left_join_unique(reports, latest, ["report_id"])
