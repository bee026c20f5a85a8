"""SimHash groups against all pairs."""

from __future__ import annotations

import re

import xxhash
from conftest import TESTDATA
from helpers import ODD_TEXTS, Groups, no_documents, odd_documents, words_of

from pyspark.sql import functions as F

from wardbook.llm import simhash


def plain_print(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest id of the component of each of ``(id, fingerprint)``."""
    groups = Groups(i for i, _ in prints)
    for n, (i, p) in enumerate(prints):
        for j, q in prints[:n]:
            if (p ^ q).bit_count() <= simhash.MAX_BITS:
                groups.join(i, j)
    return {i: groups.find(i) for i, _ in prints}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    prints = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    rows = simhash.groups(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in rows} == dict(prints)
    assert {r.doc_id: r.component_id for r in rows} == plain_groups(prints)


def test_links_are_those_of_all_pairs(spark):
    import random

    draw = random.Random(4)
    centres = [draw.getrandbits(64) for _ in range(12)]
    prints = set(centres)
    for c in centres:
        for _ in range(25):
            flips = draw.sample(range(64), draw.randrange(5))
            prints.add(c ^ sum(1 << f for f in flips))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for most in (0, 1, 2, 3, 5):
        found = {(r.a, r.b) for r in simhash.links(frame, most).collect()}
        near = {
            (max(a, b), min(a, b))
            for a in signed
            for b in signed
            if a != b and ((a ^ b) % 2**64).bit_count() <= most
        }
        assert found == near


def test_odd_rows(spark):
    rows = simhash.groups(odd_documents(spark)).collect()
    assert len(rows) == len(ODD_TEXTS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fp == by_id[2].fp == by_id[3].fp == 0
    assert by_id[3].component_id == 1 and by_id[5].component_id == 4
    assert by_id[None].component_id is None
    assert simhash.groups(no_documents(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 6, 7]
    assert simhash.keep_first(no_documents(spark)).count() == 0


def test_many_copies_make_no_pairs(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("the same five words here").alias("text")
    )
    rows = simhash.groups(docs).agg(F.max("component_id"), F.max("n_links"), F.count("*")).first()
    assert tuple(rows) == (0, 0, 3000)
