"""Near-duplicate groups by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.llm.components import component_labels
from wardbook.llm.shared import quoted, releasing, staged, unused
from wardbook.operators.counts import has_rows
from wardbook.operators.dedup import top_per_key
from wardbook.operators.keyed import left_join_unique

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Shingles hashed before their bits are summed, a bound of a task's memory.
BLOCK = 200_000
BITS = 64


def _fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    # A-Z alone are lower-cased in bytes, and split() parts at the six blanks of a word.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    first = np.append(0, ends[:-1] + 1)[:n]
    totals = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in spans]
        packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(packed, axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * totals > n, bitorder="little").view("<i8")
    return int(chosen[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as a long.

    A text with fewer words than a shingle is one shingle; null and empty texts have 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {kind}, fp long")


def _ball(segment: int, part: Column, bits: int) -> Column:
    """All keys of ``segment`` that differ from ``part`` in at most one of its bits."""
    flips = [0, *(1 << k for k in range(bits))]
    signed = (f - (1 << BITS) if f >> (BITS - 1) else f for f in flips)
    return F.transform(
        F.array(*(F.lit(f).cast("long") for f in signed)),
        lambda flip: F.struct(F.lit(segment).alias("segment"), part.bitwiseXOR(flip).alias("key")),
    )


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (``a > b``): the pairs of distinct fingerprints ``fp`` within ``max_bits``.

    The 64 bits are cut into ``max_bits // 2 + 1`` segments, so that a pair differs by at
    most one bit in some segment. Each fingerprint stands in one table per segment and asks it
    for its segment with every choice of up to one bit flipped; what the tables
    return is verified on all bits within the join. A fingerprint has a bounded number
    of others within ``max_bits``, however many documents share it.
    """
    segments = max_bits // 2 + 1
    bounds = [BITS * i // segments for i in range(segments + 1)]
    tables, probes = [], []
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        mask = F.lit(-1) if high - low == BITS else F.lit((1 << (high - low)) - 1)
        part = F.shiftrightunsigned("fp", low).bitwiseAND(mask.cast("long"))
        tables.append(F.struct(F.lit(i).alias("segment"), part.alias("key")))
        probes.append(_ball(i, part, high - low))
    one = prints.select("fp").distinct()
    table = one.select(F.col("fp").alias("b"), F.inline(F.array(*tables)))
    asked = one.select(F.col("fp").alias("a"), F.inline(F.concat(*probes)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    met = asked.join(table, ["segment", "key"]).where((F.col("a") > F.col("b")) & near)
    return met.select("a", "b").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id, n_links`` of each document.

    Documents with one fingerprint are joined through it without pairing them up, and
    fingerprints within ``max_bits`` link theirs; ``component_id`` is the smallest
    ``doc_id`` that is reached. ``n_links`` counts the other fingerprints that are near.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Every row
    gives a row; equal rows agree. A null ``doc_id`` stays, is never the smallest, and
    has a null ``component_id`` if it reaches nothing but such. An empty table gives an
    empty one.
    """
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    pairs = staged(links(prints, max_bits), "links")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    labels = component_labels(pairs).select(F.col("node").alias("fp"), "component")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(
        F.count("*").alias("n_links")
    )
    known = smallest.join(labels, "fp", "left").join(degree, "fp", "left").select(
        "fp",
        F.coalesce("component", "fp").alias("component"),
        "least_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    known = staged(known, "prints")
    ids = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = staged(
        left_join_unique(known, ids, ["component"]).select("fp", "component_id", "n_links"),
        "groups",
    )
    return left_join_unique(prints, named, ["fp"])


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: that with the smallest ``doc_id``.

    Of rows repeated under that ``doc_id`` one stays, that with the least hash of all its
    columns; only those are compared. Groups without any ``doc_id`` stay whole. The columns
    may have any names and types.
    """
    found = groups(docs, shingle, max_bits)
    own = found.where(F.col("doc_id") == F.col("component_id"))
    mark = unused("several", docs.columns)
    first = staged(own.groupBy("doc_id").agg((F.count("*") > 1).alias(mark)), "first-ids")
    named = docs.where(F.col("doc_id").isNotNull())
    # Never broadcast: the ids grow with the documents, and the plan stays the same at any size.
    kept = left_join_unique(named, first.hint("merge"), ["doc_id"])
    columns = quoted(docs.columns)
    rows = kept.where(~F.col(mark)).select(*columns)
    if has_rows(first.where(F.col(mark))):
        digest = F.xxhash64(F.to_json(F.struct(*columns)))
        one = top_per_key(kept.where(F.col(mark)), ["doc_id"], [digest], 1)
        rows = rows.unionByName(one.select(*columns))
    if has_rows(found.where(F.col("doc_id").isNull() & F.col("component_id").isNull())):
        rows = rows.unionByName(docs.where(F.col("doc_id").isNull()))
    return rows
