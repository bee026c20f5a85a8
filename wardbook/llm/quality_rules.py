"""Quality rules on counts of a text, as one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.llm.shared import BLANKS

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

# Frequent function words of the four languages.
STOP_WORDS = (
    # English
    "the of and to in is that for it as was with be by on not are this from or an at a he",
    # German
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als",
    # French
    "de la le et les des en un du une que est pour qui dans par sur au il elle",
    # Spanish
    "de la que el en y a los se del las un por con una su para es al lo como más o",
)


@dataclass(frozen=True)
class Threshold:
    """A ratio of two counts and the range it must lie in; 0 divided by 0 is 0."""

    name: str
    part: str
    whole: str
    least: float | None = None
    most: float | None = None


# The defaults are lenient: a text is dropped only where a count is far from prose.
THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", least=2.0, most=14.0),
    Threshold("symbols_per_word", "n_symbols", "n_words", most=0.3),
    Threshold("stop_words", "n_stop_words", "n_words", least=0.02),
    Threshold("capitals", "n_capitals", "word_chars", most=0.4),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", most=0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column, width: int) -> Column:
    """A hash for each window of ``width`` words, joined up from hashes of shorter ones."""

    def grown(hashes: Column, span: int) -> Column:
        if span == width:
            # What hangs over the end joined fewer words.
            return F.slice(hashes, F.lit(1), F.size(hashes) - (width - 1))
        step = min(span, width - span)
        longer = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))
        return _let(longer, lambda found: grown(found, span + step))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: grown(hashes, 1))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more in the text.

    Windows are told apart by a 64-bit hash of their words. Only a text with a repeated
    hash has its windows sorted; then those equal to a neighbour give, in order of place,
    ``width`` words each less what the next one overlaps.
    """

    def repeats(ordered: Column) -> Column:
        def has_equal(x: Column, i: Column) -> Column:
            after = F.get(ordered, i + 1)["h"] == x["h"]
            before = F.get(ordered, i - 1)["h"] == x["h"]
            return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, has_equal), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")
            ),
        )["n"]

    def counted(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            _let(F.sort_array(placed), lambda ordered: covered(repeats(ordered)))
        )

    return F.when(F.size(words) > width, _let(_windows(words, width), counted)).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each text; no user function runs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        text.alias("text"),
        F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "").alias(
            "lines"
        ),
    )
    stop = sorted({w for row in STOP_WORDS for w in row.split()})
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    return split.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )


def verdict(thresholds: Sequence[Threshold]) -> tuple[Column, Column]:
    """The table compiled: whether all hold, and the names of those that do not."""
    failed = []
    for rule in thresholds:
        whole = F.col(rule.whole)
        ratio = F.when(whole == 0, 0.0).otherwise(F.col(rule.part) / whole)
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (ratio < rule.least)
        if rule.most is not None:
            bad = bad | (ratio > rule.most)
        failed.append(F.when(bad, F.lit(rule.name)))
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return F.size(names) == 0, names


def apply_rules(docs: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """The counts of each document, ``base_failed``, ``kept`` and the ``failed`` rules.

    One row per row of ``docs``, without a shuffle. A null text counts as empty: it has no
    words, fails the base and is not kept. Columns other than ``doc_id`` and ``text`` are
    not looked at; an empty table gives an empty one.
    """
    passes, names = verdict(thresholds)
    base_failed = (F.col("n_words") < 20) | (
        100 * F.col("n_repeat_words") > 30 * F.col("n_words")
    )
    return measure(docs).select(
        "*",
        base_failed.alias("base_failed"),
        (~base_failed & passes).alias("kept"),
        names.alias("failed"),
    )
