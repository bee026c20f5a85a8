"""Quality scores learned by Bradley-Terry from pairs of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from wardbook.llm.learning import held_out, labelled_rows, logistic, matrix, moments
from wardbook.llm.shared import numbered, quoted, releasing, staged, unused

#: A document is accepted from this score on; scores are laid so that it is the quantile's.
CUT = 0.3
#: Pairs to learn from at least, as far as there are so many different ones.
PAIRS = 100_000
#: Pairs that each row of the larger class is in at least.
ROUNDS = 2
#: Steps of the scores that the cut is chosen from, and rows numbered together on average.
STEPS = 2**16
BLOCK = 10_000
_LOGIT = math.log(CUT / (1 - CUT))

_LOWER, _UPPER, _DIGIT, _MARK, _SIGN = 1, 2, 3, 4, 5
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = _LOWER
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _UPPER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(b".,;:!?'\"()-")] = _MARK
_KIND[list(b"#*$%&|<>@^~=+_{}[]/\\`")] = _SIGN


def features(text: str) -> list[float]:
    """Measures of one whole text, all finite and about of size one."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6) / size
    lines = [line for line in text.split("\n") if line.strip()]
    per_word = 1 / max(n, 1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) * per_word
    shout = sum(w.isupper() and len(w) > 1 for w in words) * per_word
    bare = sum(not any(c.isalpha() for c in w) for w in set(words)) / max(len(set(words)), 1)
    spread = len(set(words)) / max(n, 1) ** 0.8
    pairs = len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)
    used = counts[counts > 0] / size
    length = sum(map(len, words)) * per_word
    return [
        1.0 if n == 0 else 0.0,
        math.log1p(n) / 5,
        min(length, 30) / 5,
        *(float(k) for k in kinds[1:]),
        math.sqrt(kinds[_SIGN]),
        float(counts[ord("|")] / size) ** 0.5,
        float(counts[ord("!")] / size) ** 0.5,
        float(again),
        math.sqrt(again),
        float(shout),
        float(bare),
        min(spread, 3.0),
        float(pairs),
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)) / 5,
        float(-(used * np.log(used)).sum()) / 3,
    ]


WIDTH = len(features(""))


@dataclass(frozen=True)
class Ranker:
    """Score of a text: ``weights`` on its standardised features, cut at ``cut``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    pace: float

    def standard(self, rows: np.ndarray) -> np.ndarray:
        # Far-off values count as eight deviations, so no single measure decides by its size.
        return np.clip((rows - self.mean) / self.scale, -8, 8)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        # Summed row by row: a score must not depend on the rows beside it.
        return (self.standard(rows) * self.weights).sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, and ``CUT`` at the cut."""
        return 1 / (1 + np.exp(-np.clip((self.raw(rows) - self.cut) * self.pace + _LOGIT, -30, 30)))


def _numbered_rows(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with their ``place`` among those of their label, from 0 in the order of hashes."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n // BLOCK + 1)).alias("block")
    sizes = rows.groupBy("label", block).count()
    before = Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("label", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("label", "block").orderBy("doc_id")
    ranked = rows.select("*", block).withColumn("rank", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, ["label", "block"])
    return joined.select("label", "features", (F.col("start") + F.col("rank")).alias("place"))


def pairs_of(rows: DataFrame, counts: dict[int, int], least: int = PAIRS) -> DataFrame:
    """Differences of ``features``, better less worse, over pairs that every row is in.

    A row of the larger class meets the rows of the other that follow its own place: two of
    them, more where ``least`` asks for it, or all.
    """
    large, small = sorted((0, 1), key=lambda label: (-counts[label], label))
    rounds = min(counts[small], max(ROUNDS, -(-least // counts[large])))
    placed = staged(_numbered_rows(rows, sum(counts.values())), "quality-places")
    many = placed.where(F.col("label") == large).select(
        F.col("features").alias("own"),
        F.explode(F.sequence(F.col("place"), F.col("place") + rounds - 1)).alias("place"),
    )
    few = placed.where(F.col("label") == small).select("place", F.col("features").alias("other"))
    met = many.withColumn("place", F.col("place") % counts[small]).join(few, "place")
    better, worse = ("own", "other") if large == 1 else ("other", "own")
    return met.select(F.zip_with(better, worse, lambda x, y: x - y).alias("features"))


def best_cut(steps: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Where fewest rows are on the wrong side, and the deviation, both in steps.

    ``steps`` holds step, rows of label 0 and rows of label 1; of equally good places between
    steps the middle one is taken.
    """
    at, bad, good = (np.array(c) for c in zip(*sorted(steps), strict=True))
    # Cutting before place k keeps places k and up.
    wrong = np.append(0, np.cumsum(good)) + np.append(np.cumsum(bad[::-1])[::-1], 0)
    share = np.flatnonzero(wrong == wrong.min())
    k = int(share[len(share) // 2])
    below, above = at[k - 1] + 1 if k else at[0], at[k] if k < len(at) else at[-1] + 1
    size, n = bad + good, int((bad + good).sum())
    mean = int((at * size).sum()) / n
    return (int(below) + int(above)) / 2, math.sqrt(float(((at - mean) ** 2 * size).sum()) / n)


def fit(rows: DataFrame) -> Ranker:
    """Learn from preferences: a document of label 1 beats one of label 0.

    ``rows`` has ``doc_id``, ``label`` and ``features``. The logistic loss on the differences
    of ``pairs_of`` gives the weights. The cut is the quantile of the scores of all rows
    with the fewest of them on the wrong side, to a step of ``STEPS``. Without rows of both
    labels all scores equal the cut.
    """
    counts = {0: 0, 1: 0, **dict(rows.groupBy("label").count().collect())}
    if not counts[0] or not counts[1]:
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 1.0)
    mean, scale = moments(rows, WIDTH)
    model = Ranker(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(WIDTH), 0.0, 1.0)

    def standard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.standard(matrix(batch.column("features"), WIDTH)).tolist()
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "features"])

    even = rows.mapInArrow(releasing(standard), rows.schema)
    gaps = staged(pairs_of(even, counts).withColumn("target", F.lit(1)), "quality-pairs")
    model = Ranker(mean, model.scale, logistic(gaps, WIDTH), 0.0, 1.0)
    step = 16 * max(float(np.abs(model.weights).sum()), 1e-9) / STEPS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(matrix(batch.column("features"), WIDTH))
            found = pa.array(np.floor(raw / step).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([found, batch.column("label")], names=["step", "label"])

    placed = rows.mapInArrow(releasing(place), "step long, label int").groupBy("step")
    steps = placed.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).collect()
    cut, spread = best_cut([tuple(r) for r in steps])
    return Ranker(mean, model.scale, model.weights, cut * step, 4 / max(spread * step, 1e-9))


def _rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], dtype=np.float64).reshape(-1, WIDTH)


def learn(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on the features of all labelled documents, measured on the executors."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measured = _rows(batch.column("text").to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(measured, pa.list_(pa.float64()))],
                names=["doc_id", "label", "features"],
            )

    found = labelled_rows(docs, labels, "quality")
    rows = found.mapInArrow(releasing(run), f"doc_id {kind}, label int, features array<double>")
    return fit(staged(rows, "quality-features"))


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` behind all its columns.

    Should ``docs`` have such columns, the new ones get underscores before their names.
    A null text scores like an empty one. Only the text is looked at; every row gives a
    row, and an empty table an empty one.
    """
    at, verdict = unused("score", docs.columns), unused("predicted", docs.columns)
    plain, place = numbered(docs), f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_rows(batch.column(place).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(found, pa.float64()),
                    pa.array((found >= CUT).astype(np.int32), pa.int32()),
                ],
                names=[*batch.schema.names, "score", "predicted"],
            )

    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    scored = plain.mapInArrow(releasing(run), StructType([*plain.schema.fields, *added]))
    return scored.toDF(*docs.columns, at, verdict)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Learns from labelled documents outside the held-out fifth. See ``score`` and
    ``labelled_rows`` for odd rows; without usable labels every score is the cut.
    """
    model = learn(docs, labels)
    rated = score(docs.select("doc_id", "text"), model)
    return rated.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns."""
    model = learn(docs, labels)
    verdict = unused("predicted", docs.columns)
    return score(docs, model).where(F.col(verdict) == 1).select(*quoted(docs.columns))
