"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.shared import staged
from wardbook.operators.keyed import left_join_unique


def _state(edges: DataFrame):
    """A fingerprint of an edge set."""
    hashed = F.xxhash64("a", "b")
    # Halves keep the sums far from overflow.
    return edges.agg(
        F.count("*"),
        F.sum(F.shiftrightunsigned(hashed, 32)),
        F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))),
    ).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or the smaller) neighbours of each node to its smallest one.

    ``edges`` has ``a > b``. The smallest neighbour comes from a partially aggregated
    minimum, and the edges of a node with many are split by adaptive joins: no task
    holds a node's neighbours together.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        tied = left_join_unique(both.where(F.col("b") > F.col("a")), least, ["a"])
        pairs = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = left_join_unique(edges, least, ["a"])
        pairs = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return pairs.where(F.col("a") != F.col("b")).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``); the component is its
    smallest node.

    Large and small stars alternate until the edges stay as they are, which takes a
    number of rounds that grows with the logarithm of the longest path. Each round is
    written to the shared folder. Loops and repeated edges are allowed, nulls are not;
    no edges give no rows.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = staged(ordered.distinct(), "edges")
    state = _state(current)
    while state[0]:
        current = staged(_star(_star(current, large=True), large=False), "stars")
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
