"""Union, newest-first deduplication, last visits and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANK = "__rank"


def union_widened(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; a column that one side lacks is null there."""
    return first.unionByName(second, allowMissingColumns=True)


def row_digest(df: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """A hash of the whole row, to order rows that tie on everything else."""
    return F.xxhash64(*(c for c in df.columns if c not in leave_out))


def top_per_key(
    df: DataFrame,
    keys: list[Column | str],
    order: list[Column],
    k: int,
    rank_as: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of every key, with their rank if it is given a name.

    Spark cuts each key to ``k`` rows per task before the shuffle and again after
    it, so a hot key moves at most ``k`` rows per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn(_RANK, rank).filter(F.col(_RANK) <= k)
    return kept.withColumnRenamed(_RANK, rank_as) if rank_as else kept.drop(_RANK)


def keep_newest(
    df: DataFrame, keys: list[Column | str], time: Column, tie: list[Column]
) -> DataFrame:
    """The newest row of every key; nulls count as equal keys.

    ``tie`` decides between rows of the same time and should make the order total.
    """
    return top_per_key(df, keys, [time.desc_nulls_last(), *tie], 1)


def last_visits(
    records: DataFrame,
    key: str,
    time: Column,
    tie: list[Column],
    visits: int,
    rank_as: str | None = None,
) -> DataFrame:
    """The last visits of every patient."""
    return top_per_key(records, [key], [time.desc_nulls_last(), *tie], visits, rank_as)


def newest_first(df: DataFrame, time: Column, tie: list[Column]) -> DataFrame:
    """O1: global order, newest first, unreadable times last.

    The tie columns are part of the range boundaries too, so a time shared by a
    large part of the rows (null, say) still spreads over many tasks.
    """
    return df.orderBy(time.desc_nulls_last(), *tie)


def by_date_desc(df: DataFrame, id_column: str) -> DataFrame:
    """O2, O3: latest date first, a missing date last, then by id."""
    return df.orderBy(F.coalesce("date", F.lit("")).desc(), F.col(id_column))


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """A first look at the rows."""
    return df.limit(rows)
