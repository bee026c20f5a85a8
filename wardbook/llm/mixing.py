"""Mix sources to target weights by whole and Bernoulli repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.llm.shared import count_words, quoted, staged

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
TRIALS = 64


def source_weights(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row per source with its size and weight, sources ordered by code point, null last.

    The place of a source comes from a range sort and the row counts of the ranges, so
    no task sees more than its range of sources.
    """
    spark = sizes.sparkSession
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # UTF-8 strings compare by bytes, which is code point order.
    ranged = per_source.sort(F.asc_nulls_last("source")).withColumns(
        {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}
    )
    ranged = staged(ranged, "sources")
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, start = {}, 0
    for part in sorted(counts):
        before[part], start = start, start + counts[part]
    if not before:
        return ranged.select("source", "source_size", F.lit(0.0).alias("weight"))
    starts = spark.createDataFrame(list(before.items()), "part int, start long")
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    table = F.array(*(F.lit(float(w)) for w in weights))
    return ranged.join(starts, "part").select(
        "source",
        "source_size",
        table[F.pmod(F.col("start") + within, F.lit(len(weights))).cast("int")].alias("weight"),
    )


def fill_targets(sources: DataFrame, max_repeats: float) -> DataFrame:
    """Add ``target``: shares by weight of all sizes, at most ``max_repeats`` x the source.

    What stands above a cap is shared again by weight among the rest until no target is
    above its cap; each round is one aggregation of the sources to three numbers.
    """
    cap = F.col("source_size") * F.lit(float(max_repeats))
    level: float | None = None
    while True:
        capped = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("whole"),
            F.sum(F.when(capped, cap)).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        if not row.whole or not row.open:
            break
        risen = (row.whole - (row.full or 0.0)) / row.open
        if level is not None and risen <= level:
            break
        level = risen
    share = F.col("weight") * F.lit(level or 0.0)
    return sources.withColumn("target", F.least(cap, share).cast("double"))


def _chance(row_key: Column, trial: Column) -> Column:
    """A number in [0, 1) from the document and the trial."""
    digest = F.md5(F.concat_ws(":", trial.cast("string"), row_key).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _copies(doc_id: Column) -> Column:
    """Copies of a document with words, from its source's ``rate`` and ``seed``."""
    fraction = F.col("rate") - F.floor("rate")
    extra = F.when(_chance(_key(doc_id), F.col("seed")) < fraction, 1).otherwise(0)
    return F.when(F.col("size") > 0, F.floor("rate") + extra).otherwise(0).cast("long")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _sized(docs: DataFrame) -> DataFrame:
    return staged(
        docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes"
    )


def _of_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what their source has; null sources are one source.

    ``sources`` has one row each, so adaptive execution may split a hot one's rows.
    """
    named = sources.withColumnRenamed("source", "__source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def plan_sources(
    sizes: DataFrame, weights: Sequence[float], max_repeats: float, trials: int
) -> DataFrame:
    """``source, source_size, target, rate, seed``, one row per source, written aside.

    Of ``trials`` seeds each source takes the one whose words come nearest its target, the
    first of equals; the sums of all seeds are one aggregation.
    """
    filled = fill_targets(source_weights(sizes, weights), max_repeats)
    share = F.col("target") / F.col("source_size")
    sources = staged(
        filled.select(
            "source",
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, share).otherwise(0.0).alias("rate"),
        ),
        "targets",
    )
    fraction = F.col("rate") - F.floor("rate")
    tried = _of_source(sizes, sources).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("seed")
    )
    taken = F.when(_chance(_key(F.col("doc_id")), F.col("seed")) < fraction, F.col("size"))
    totals = tried.groupBy("source", "source_size", "target", "rate", "seed").agg(
        F.sum(F.coalesce(taken, F.lit(0))).alias("extra")
    )
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    miss = F.abs(F.col("extra") - wanted)
    return staged(
        totals.groupBy("source", "source_size", "target", "rate").agg(
            F.min_by("seed", F.struct(miss, "seed")).alias("seed")
        ),
        "seeds",
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: float = MAX_REPEATS,
    trials: int = TRIALS,
) -> DataFrame:
    """Number of copies of each document that bring each source to its target.

    ``docs`` has ``doc_id``, ``text`` and ``source``. A document of a source with rate
    ``target / source_size`` is taken ``floor(rate)`` times, plus once more if its hash,
    seeded by a number of its source, falls below the rate's fraction.

    Returns ``doc_id, source, size, source_size, target, copies, taken``. Null text has
    size 0, a null source is a source of its own, after the others. Sources without words have
    target 0 and rate 0: their documents, like all without words, are taken 0 times.
    Equal rows of one ``doc_id`` decide alike; an empty table gives an empty one.
    """
    sizes = _sized(docs)
    rated = _of_source(sizes, plan_sources(sizes, weights, max_repeats, trials))
    return rated.select(
        "doc_id", "source", "size", "source_size", "target", _copies(F.col("doc_id")).alias("copies")
    ).withColumn("taken", F.col("size") * F.col("copies"))


def emit(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: float = MAX_REPEATS,
    trials: int = TRIALS,
) -> DataFrame:
    """The rows of ``docs`` in the mix, each as often as ``mix`` takes it.

    All columns stay, whatever their names.
    """
    plan = plan_sources(_sized(docs), weights, max_repeats, trials)
    whole = F.struct(*quoted(docs.columns)).alias("row")
    rows = docs.select(
        whole, "doc_id", "source", count_words(F.col("text")).alias("size")
    )
    again = F.array_repeat(F.col("row"), _copies(F.col("doc_id")).cast("int"))
    repeated = _of_source(rows, plan).select(F.explode(again).alias("row"))
    return repeated.select(*(F.col("row")[c].alias(c) for c in docs.columns))
