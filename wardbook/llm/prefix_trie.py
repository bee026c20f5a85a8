"""The trie of conversation prefixes, from sorted matrices of turn ids."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardbook.llm.shared import staged
from wardbook.operators.counts import has_rows
from wardbook.operators.keyed import left_join_unique

#: Turns that a row of a matrix holds; longer conversations have a row per stretch.
BAND = 16
#: Rows of a shard, more or less, once there are more shards than shuffle partitions.
SHARD_ROWS = 50_000
#: Stretches of a conversation that are summed up by one window.
BLOCK = 1_024
# Conversations share the first turns of the multiple of FAMILY at or below
# their id, as many as the checksum of the id modulo HEADS says.
FAMILY = 5
HEADS = 9

_PAD = np.iinfo(np.int64).min
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_ORDER = ["band", "p1", "p2", "ids", "more", "conv_id"]


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, a, b, n_bytes``: two hashes stand for role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit("|"), role).alias("b"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation within a sorted task."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        at = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        if ids[0] == last:
            at[: starts[1] if len(starts) > 1 else None] += seen
        last, seen = ids[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "a", "b", "n_bytes")),
             pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(at)],
            names=["conv_id", "a", "b", "n_bytes", "part", "at"],
        )


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, a, b, n_bytes, at``: the turns of each conversation, counted from 1.

    The order is that of ``turn``, null first, then of the hashes. Ranges of the sorted rows
    are counted apart and a conversation's earlier ranges added, so no task needs a whole
    conversation.
    """
    turns = _turns(conversations)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = "conv_id long, a long, b long, n_bytes long, part int, at long"
    counted = staged(ranged.mapInArrow(_count, ddl), "turns")
    parts = counted.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("conv_id", "part", F.sum("rows").over(earlier).alias("before")).dropna()
    placed = left_join_unique(counted, before, ["conv_id", "part"])
    at = F.col("at") + F.coalesce("before", F.lit(0))
    return placed.select("conv_id", "a", "b", "n_bytes", at.alias("at"))


def _shared_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, at, x1, x2, n_bytes`` of all rebuilt turns.

    A conversation without any has one row with ``at`` 0 and nulls; so have all others.
    """
    heads = (
        turns.where((F.col("at") < HEADS) & (F.col("conv_id") % FAMILY == 0))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "n_bytes"))).alias("head"))
        .withColumnRenamed("conv_id", "base")
    )
    ids = turns.select("conv_id").distinct()
    based = ids.withColumns(
        {"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": _shared_turns(F.col("conv_id"))}
    )
    based = left_join_unique(based, heads, ["base"])
    empty = F.array().cast(heads.schema["head"].dataType)
    taken = F.slice(F.coalesce("head", empty), F.lit(1), F.col("h"))
    plan = staged(based.select("conv_id", "h", taken.alias("taken")), "heads")
    first = plan.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.*")
    sizes = plan.select("conv_id", "h", F.size("taken").alias("m"))
    own = left_join_unique(turns, sizes, ["conv_id"]).where(F.col("at") > F.col("h"))
    own = own.withColumn("at", F.col("at") - F.col("h") + F.col("m"))
    columns = ["conv_id", "at", "a", "b", "n_bytes"]
    rows = first.select(*columns).unionByName(own.select(*columns))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("x1", "x2", "n_bytes")]
    return rows.select(
        "conv_id", "at", F.xxhash64("a", "b", "at").alias("x1"), F.xxhash64("b", "at", "a").alias("x2"), "n_bytes"
    ).unionByName(plan.select("conv_id", F.lit(0).cast("long").alias("at"), *nothing))


def stretches(rows: DataFrame) -> DataFrame:
    """``conv_id, band, p1, p2, ids, sizes, more, tail``: up to ``BAND`` turns a row.

    ``ids`` are the hashes of the turns with their places, two per turn; ``p1, p2`` the exclusive
    or of all earlier ones, which names the prefix; ``tail`` the bytes of all later turns.
    """
    band = F.greatest(F.floor((F.col("at") - 1) / BAND), F.lit(0)).alias("band")
    turn = F.when(F.col("at") > 0, F.struct("at", "x1", "x2", "n_bytes"))
    grouped = rows.groupBy("conv_id", band).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        *(F.coalesce(F.bit_xor(c), F.lit(0)).alias(c) for c in ("x1", "x2")),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"),
    )
    block = F.floor(F.col("band") / BLOCK)
    segments = staged(
        grouped.select(
            "conv_id",
            "band",
            block.alias("block"),
            F.flatten(F.transform("turns", lambda t: F.array(t["x1"], t["x2"]))).alias("ids"),
            F.transform("turns", lambda t: t["n_bytes"]).alias("sizes"),
            "x1",
            "x2",
            "n_bytes",
        ),
        "stretches",
    )
    own = Window.partitionBy("conv_id", "block").orderBy("band")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    passed = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = segments.groupBy("conv_id", "block").agg(
        F.bit_xor("x1").alias("x1"),
        F.bit_xor("x2").alias("x2"),
        F.sum("n_bytes").alias("n_bytes"),
        F.max("band").alias("band"),
    )
    blocks = blocks.select(
        "conv_id",
        "block",
        *(F.coalesce(F.bit_xor(c).over(passed), F.lit(0)).alias(f"before_{c}") for c in ("x1", "x2")),
        F.coalesce(F.sum("n_bytes").over(passed), F.lit(0)).alias("before_bytes"),
        F.sum("n_bytes").over(every).alias("all_bytes"),
        F.max("band").over(every).alias("last"),
    )
    inner = segments.withColumns(
        {
            "p1": F.coalesce(F.bit_xor("x1").over(past), F.lit(0)),
            "p2": F.coalesce(F.bit_xor("x2").over(past), F.lit(0)),
            "until": F.sum("n_bytes").over(own.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    joined = left_join_unique(inner, blocks, ["conv_id", "block"])
    return joined.select(
        "conv_id",
        "band",
        F.col("p1").bitwiseXOR(F.col("before_x1")).alias("p1"),
        F.col("p2").bitwiseXOR(F.col("before_x2")).alias("p2"),
        "ids",
        "sizes",
        (F.col("band") < F.col("last")).alias("more"),
        (F.col("all_bytes") - F.col("before_bytes") - F.col("until")).alias("tail"),
    )


class _Shard:
    """The rows of one range as matrices, in order, with a row of each neighbouring range.

    ``mask[i, j]`` says that row ``i`` starts a node ``j`` turns into the stretch: that its
    prefix or one of its first ``j`` turns differs from the row before.
    """

    def __init__(self, rows: pd.DataFrame):
        size = rows["sizes"].map(len).to_numpy()
        width = int(size.max(initial=0))
        filled = np.arange(width)[None, :] < size[:, None]

        def matrix(flat: np.ndarray, pad: int) -> np.ndarray:
            whole = np.full((len(rows), width), pad, dtype=np.int64)
            whole[filled] = flat
            return whole

        turns = np.concatenate([*rows["ids"], np.zeros(0, dtype=np.int64)]).astype(np.int64)
        x1, x2 = matrix(turns[0::2], _PAD), matrix(turns[1::2], _PAD)
        sizes = np.concatenate([*rows["sizes"], np.zeros(0, dtype=np.int64)])
        n_bytes = matrix(sizes.astype(np.int64), 0)
        names = ("conv_id", "band", "p1", "p2", "more", "tag")
        conv, band, p1, p2, more, tag = (rows[c].to_numpy() for c in names)
        keys = [conv, more]
        for j in reversed(range(width)):
            keys += [x2[:, j], x1[:, j]]
        order = np.lexsort([*keys, p2, p1, band])
        x1, x2, n_bytes, filled = x1[order], x2[order], n_bytes[order], filled[order]
        conv, band, p1, p2, more, tag, size = (
            c[order] for c in (conv, band, p1, p2, more, tag, size)
        )
        change = np.ones((len(rows), width + 1), dtype=bool)
        change[1:, 0] = (band[1:] != band[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
        change[1:, 1:] = (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])
        mask = np.logical_or.accumulate(change, axis=1)
        following = np.vstack([mask[1:], np.ones((1, width + 1), dtype=bool)])
        inner = tag == 0
        self.width, self.order = width, order[inner]
        self.conv, self.band, self.size = conv[inner], band[inner], size[inner]
        self.more = more[inner].astype(bool)
        self.mask, self.following = mask[inner], following[inner]
        self.n_bytes = n_bytes[inner]
        self.starts = self.mask[:, 1:] & filled[inner]
        self.owned = np.where(self.starts, self.n_bytes, 0)
        # Nothing follows that has all turns of this row.
        self.leaf = ~self.more & self.following[np.arange(len(self.conv)), self.size]

        def states(first: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.bitwise_xor.accumulate(np.column_stack([first, x])[inner], axis=1)

        self.s1, self.s2 = states(p1, x1), states(p2, x2)


_OWNED_DDL = "conv_id long, band long, owned long, child long, leaf long"


def _owned(rows: pd.DataFrame) -> pd.DataFrame:
    """What the stretches of long conversations add to their earlier ones."""
    shard = _Shard(rows)
    long = (shard.band > 0) | shard.more
    child = shard.starts[:, 0] if shard.width else np.zeros(len(shard.conv), dtype=bool)
    return pd.DataFrame(
        {
            "conv_id": shard.conv[long],
            "band": shard.band[long],
            "owned": shard.owned.sum(axis=1)[long],
            "child": child[long].astype(np.int64),
            "leaf": shard.leaf[long].astype(np.int64),
        }
    )


_NODES_DDL = (
    "depth long, s1 long, s2 long, q1 long, q2 long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "ends_sha256 string, shard int, is_open boolean, is_sought boolean"
)


def _suffix_sums(values: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Column j: the sum from column j on and of ``last``; one column more than ``values``."""
    whole = np.column_stack([values, last])
    return np.cumsum(whole[:, ::-1], axis=1)[:, ::-1]


def _nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard, every depth by ``reduceat`` over its starts.

    All values of a node are sums over its members or their least id, so the parts of a node
    that several shards hold add up. Of the nodes below a node each is counted by the one
    member that starts it: ``saved_tokens`` is the bytes of all members' turns less those of
    the distinct ones.
    """
    number = int(rows["shard"].iloc[0])
    shard = _Shard(rows)
    count = len(shard.conv)
    tail, own_after, child_after, leaf_after = (
        rows[c].to_numpy()[shard.order] for c in ("tail", "own_after", "child_after", "leaf_after")
    )
    # Column j - 1 is the sum from the turn at depth j on.
    heard = _suffix_sums(shard.n_bytes, tail)
    distinct = _suffix_sums(shard.owned, own_after)
    leaf = np.where(shard.more, leaf_after, shard.leaf.astype(np.int64))
    ones = np.ones(count, dtype=np.int64)
    found, above, above_open = [], None, None
    for j in range(shard.width + 1):
        first = shard.mask[:, j].copy()
        first[0] = True
        begin = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        is_open = np.zeros(len(begin), dtype=bool)
        is_open[0] |= not shard.mask[0, j]
        is_open[-1] |= not shard.following[-1, j]
        least = np.minimum.reduceat(shard.conv, begin)
        chosen = shard.size[begin] >= j if j else shard.band[begin] == 0
        next_children = (
            shard.starts[:, j].astype(np.int64) if j < shard.width else np.zeros(count, dtype=np.int64)
        )
        if j == BAND:
            next_children = child_after
        at = max(j - 1, 0)
        ending = (shard.size == j) & ~shard.more
        ends = np.add.reduceat(ending.astype(np.int64), begin)
        depth = shard.band[begin] * BAND + j
        frame = pd.DataFrame(
            {
                "depth": depth,
                "s1": shard.s1[begin, j],
                "s2": shard.s2[begin, j],
                "q1": shard.s1[begin, at],
                "q2": shard.s2[begin, at],
                "conv_id": least,
                "parent_conv_id": pd.array([pd.NA] * len(begin), dtype="Int64"),
                "n_convs": np.add.reduceat(ones, begin),
                "n_children": np.add.reduceat(next_children, begin),
                "n_leaves": np.add.reduceat(leaf, begin),
                "saved_tokens": np.add.reduceat(heard[:, at] - distinct[:, at], begin),
                "ends": None,
                "ends_sha256": None,
                "shard": np.int32(number),
                "is_open": is_open,
                "is_sought": is_open | ((np.add.reduceat(shard.more.astype(np.int64), begin) > 0) & (j == BAND)),
            }
        )
        if j:
            of = run_before[begin]
            parent = pd.array(above[of], dtype="Int64")
            unknown = above_open[of] | ((j == 1) & (shard.band[begin] > 0))
            parent[unknown] = pd.NA
            frame["parent_conv_id"] = parent
        texts: list[str | None] = [None] * len(begin)
        hashes: list[str | None] = [None if o else _NO_ENDS for o in is_open]
        for i in np.flatnonzero(chosen & (ends > 0)):
            ids = shard.conv[begin[i] : begin[i] + ends[i]]
            text = ",".join(map(str, ids.tolist()))
            if is_open[i]:
                texts[i] = text
            else:
                hashes[i] = hashlib.sha256(text.encode()).hexdigest()
        frame["ends"], frame["ends_sha256"] = texts, hashes
        found.append(frame[chosen])
        run_before, above, above_open = run, least, is_open
    return pd.concat(found, ignore_index=True)


def _by_shard(rows: DataFrame, edges: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """``run`` over each shard with the rows next to it; shards without rows are left out."""
    both = rows.withColumn("tag", F.lit(0)).unionByName(edges, allowMissingColumns=True)
    numbers = [c for c in ("tail", "own_after", "child_after", "leaf_after") if c in both.columns]
    return both.fillna(0, numbers).groupBy("shard").applyInPandas(run, ddl)


def _edges(rows: DataFrame) -> DataFrame:
    """The last row of the shard before and the first of the one after, for each shard.

    One row per shard meets in the window that finds the neighbours.
    """
    fields = [*_ORDER, "sizes"]
    ends = rows.groupBy("shard").agg(
        F.min(F.struct(*fields)).alias("first"), F.max(F.struct(*fields)).alias("last")
    )
    order = Window.orderBy("shard")
    before, after = F.lag("last").over(order), F.lead("first").over(order)
    found = ends.select("shard", before.alias("before"), after.alias("after"))
    return (
        found.select("shard", F.lit(-1).alias("tag"), "before.*")
        .unionByName(found.select("shard", F.lit(1).alias("tag"), "after.*"))
        .where(F.col("conv_id").isNotNull())
    )


def _carried(owned: DataFrame) -> DataFrame:
    """``conv_id, band, own_after, child_after, leaf_after`` from what later stretches own."""
    block = F.floor(F.col("band") / BLOCK).alias("block")
    rows = staged(owned.select("*", block), "owned")
    every = Window.partitionBy("conv_id")
    until = every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(
        F.sum("owned").alias("owned"), F.max("leaf").alias("leaf")
    )
    blocks = blocks.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("owned").over(until), F.lit(0)).alias("before"),
        F.sum("owned").over(every).alias("whole"),
        F.max("leaf").over(every).alias("leaf_after"),
    )
    inner = Window.partitionBy("conv_id", "block").orderBy("band")
    running = F.sum("owned").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    summed = left_join_unique(rows.withColumn("until", running), blocks, ["conv_id", "block"])
    children = rows.select("conv_id", (F.col("band") - 1).alias("band"), F.col("child").alias("child_after"))
    return left_join_unique(summed, children, ["conv_id", "band"]).select(
        "conv_id",
        "band",
        (F.col("whole") - F.col("before") - F.col("until")).alias("own_after"),
        F.coalesce("child_after", F.lit(0)).alias("child_after"),
        "leaf_after",
    )


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, in order; one chunk is held at a time."""
    key, state = None, None

    def row(key: tuple, state) -> pa.RecordBatch:
        values = [pa.array([k], pa.int64()) for k in key]
        return pa.RecordBatch.from_arrays(
            [*values, pa.array([state.hexdigest()])], names=["depth", "s1", "s2", "sha"]
        )

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("depth", "s1", "s2")), strict=True)
        for own, text in zip(keys, batch.column("ends"), strict=True):
            if own != key:
                if key is not None:
                    yield row(key, state)
                key, state = own, hashlib.sha256(text.as_py().encode())
            else:
                state.update(b"," + text.as_py().encode())
    if key is not None:
        yield row(key, state)


def _recombined(parts: DataFrame) -> DataFrame:
    """Nodes that several shards hold, from their parts."""
    key = ["depth", "s1", "s2"]
    merged = parts.groupBy(*key).agg(
        F.min("q1").alias("q1"),
        F.min("q2").alias("q2"),
        F.min("conv_id").alias("conv_id"),
        F.min("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    chunks = parts.where(F.col("ends").isNotNull()).select(*key, "shard", "ends")
    chunks = chunks.repartition(*key).sortWithinPartitions(*key, "shard")
    hashed = chunks.mapInArrow(_digest_chunks, "depth long, s1 long, s2 long, sha string")
    return left_join_unique(merged, hashed, key).select(
        *(c for c in merged.columns),
        F.coalesce("sha", F.lit(_NO_ENDS)).alias("ends_sha256"),
        F.lit(True).alias("is_sought"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` of every node.

    Conversations are first rebuilt from shared heads (``rebuilt``). The stretches of 16 turns
    are sorted and cut in ranges of rows, equal ones by their id, so neither a first turn nor
    copies nor a conversation that a third of all rows have meet in one task. Each range makes
    its nodes alone, knowing only the row before and after it; the parts of a node that
    crosses ranges are added up, and children of such a node look up its least id. A
    conversation longer than a stretch is sorted once more, for what its later stretches add.

    Null role and text are empty. Turns of one number, null included, are in the order of
    their hashes, and repeated rows are turns of their own. Rows without ``conv_id`` are in
    no conversation; other columns, whatever their names, are not read. An empty table has
    no members and gives an empty table. Turns are told apart by 128 bits of their hashes.
    """
    rows = staged(stretches(rebuilt(staged(numbered(conversations), "numbered"))), "rows")
    spark = rows.sparkSession
    shards = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / SHARD_ROWS)
    )
    ranged = rows.repartitionByRange(shards, *_ORDER).withColumn("shard", F.spark_partition_id())
    ranged = staged(ranged, "shards")
    edges = staged(_edges(ranged), "edges")
    if has_rows(ranged.where(F.col("band") > 0)):
        carried = _carried(_by_shard(ranged, edges, _owned, _OWNED_DDL))
        ranged = left_join_unique(ranged, carried, ["conv_id", "band"])
    else:
        ranged = ranged.withColumns({c: F.lit(0) for c in ("own_after", "child_after", "leaf_after")})
    parts = staged(_by_shard(ranged, edges, _nodes, _NODES_DDL), "nodes")
    merged = staged(_recombined(parts.where("is_open")), "open-nodes")
    nodes = parts.where("NOT is_open").drop("ends", "shard", "is_open").unionByName(merged)
    sought = nodes.where("is_sought").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("s1").alias("q1"),
        F.col("s2").alias("q2"),
        F.col("conv_id").alias("found"),
    )
    orphan = (F.col("depth") > 0) & F.col("parent_conv_id").isNull()
    named = left_join_unique(nodes.where(orphan), sought, ["depth", "q1", "q2"])
    named = named.withColumn("parent_conv_id", F.col("found")).drop("found")
    return nodes.where(~orphan).unionByName(named).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )
