"""The prefix trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardbook.llm.prefix_trie import BAND, numbered, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """``(conv_id, depth, parent, members, children, leaves, saved, ends)`` of every node."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: [(r, s) for _, _, r, s in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in whole:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = whole.get(base, [])[:h] + whole[c][h:]
    root = {"members": [], "ends": [], "children": {}, "n_bytes": 0, "depth": 0}
    for c in sorted(built):
        node = root
        node["members"].append(c)
        for turn in built[c]:
            fresh = {
                "members": [], "ends": [], "children": {}, "depth": node["depth"] + 1,
                "n_bytes": len(turn[1].encode()),
            }
            node = node["children"].setdefault(turn, fresh)
            node["members"].append(c)
        node["ends"].append(c)
    found, order, todo = [], [], [(root, None)] if built else []
    while todo:
        node, parent = todo.pop()
        order.append((node, parent))
        todo += [(child, node) for child in node["children"].values()]
    for node, parent in reversed(order):
        children = node["children"].values()
        node["leaves"] = sum(x["leaves"] for x in children) or 1
        own = (len(node["members"]) - 1) * node["n_bytes"]
        node["saved"] = own + sum(x["saved"] for x in children)
        ends = ",".join(map(str, node["ends"])).encode()
        found.append(
            (
                node["members"][0], node["depth"], parent and parent["members"][0],
                len(node["members"]), len(children), node["leaves"], node["saved"],
                hashlib.sha256(ends).hexdigest(),
            )
        )
    return sorted(found, key=repr)


def compare(spark, rows, extra=None):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        docs = docs.withColumns(extra)
    found = sorted((tuple(r) for r in trie(docs).collect()), key=repr)
    assert found == plain(rows)
    return found


def conversation(conv_id, texts):
    return [(conv_id, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    """Few different turns, so prefixes are shared at every depth, also past one stretch."""
    draw = random.Random(seed)
    rows = []
    for conv_id in draw.sample(range(-40, 400), 150):
        length = draw.choice([0, 1, 2, 3, 8, 9, 15, 16, 17, 18, 31, 32, 33, 34, 50])
        start = draw.choice(["a", "é日本", ""])
        rows += conversation(conv_id, [start if i < 40 else draw.choice("xy") for i in range(length)])
    compare(spark, rows)


def test_copies_that_fill_several_ranges(spark):
    """One conversation and its extensions hold most rows and cross the ranges."""
    rows = []
    for conv_id in range(0, 2000, 5):
        rows += conversation(conv_id, ["same"] * (20 if conv_id % 3 else 18 + conv_id % 2))
    for conv_id in range(3, 300, 5):
        rows += conversation(conv_id, ["same", "other", str(conv_id % 7)])
    found = compare(spark, rows)
    assert max(n for _, d, _, n, *_ in found if d == 18) > 300


def test_a_conversation_with_most_of_the_turns(spark):
    rows = conversation(5, [str(i % 11) for i in range(40 * BAND)])
    rows += conversation(10, [str(i % 11) for i in range(40 * BAND - 1)] + ["end"])
    rows += [r for c in range(100, 130) for r in conversation(c, ["0", "1", "z"][: c % 4])]
    compare(spark, rows)


def test_odd_rows(spark):
    rows = conversation(1, ["a", "b"]) + conversation(5, ["a"]) + conversation(6, ["q"] * 9)
    rows += [(7, None, None, None), (7, 3, "user", None), (7, 2, None, "x"), (None, 1, "user", "lost")]
    rows += [(8, 1, "user", "twice"), (8, 1, "user", "twice"), (9, 0, "", ""), (9, 1, "user", "long " * 30000)]
    rows += [(-3, 0, "user", "below zero"), (2**62, 0, "user", "far")]
    extra = {"depth": F.lit(1), "at": F.lit("x"), "ids": F.lit(2), "more": F.lit(3), "shard": F.lit(4)}
    compare(spark, rows, extra)


def test_no_rows(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0


def test_turns_are_numbered_across_ranges(spark):
    rows = [(1, i, "user", str(i)) for i in range(500)] + [(2, None, "user", "n"), (2, 0, "user", "z")]
    found = numbered(spark.createDataFrame(rows, SCHEMA)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("at")).alias("at")
    )
    assert {r.conv_id: list(r["at"]) for r in found.collect()} == {1: list(range(1, 501)), 2: [1, 2]}
