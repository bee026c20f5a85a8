"""The mix against targets filled by hand."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import TESTDATA
from helpers import ODD_TEXTS, no_documents, odd_documents, words_of

from wardbook.llm import mixing


def plain_targets(sizes):
    """Targets of ``source -> size`` by sharing anew what stands above a cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, full, rest = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        target.update({s: rest * weight[s] / total for s in free})
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            full.add(s)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    sizes, taken = Counter(), Counter()
    for r in docs.collect():
        assert rows[r.doc_id].size == len(words_of(r.text))
        sizes[r.source] += rows[r.doc_id].size
        taken[r.source] += rows[r.doc_id].taken
        assert rows[r.doc_id].taken <= 3 * rows[r.doc_id].size
    targets = plain_targets(sizes)
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.15)
    for r in docs.collect():
        assert rows[r.doc_id].target == pytest.approx(targets[r.source])
    assert {r.doc_id: r for r in mixing.mix(docs.repartition(3)).collect()} == rows


def test_emitted_rows_are_the_copies(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    assert Counter(r.doc_id for r in emitted.collect()) == copies


def test_small_sources_are_capped(spark):
    rows = [(i, "w " * 10, "a") for i in range(2)] + [(10 + i, "w " * 10, "b") for i in range(98)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    targets = {r.source: r.target for r in found.collect()}
    assert targets == {"a": 60.0, "b": 940.0}


def test_odd_rows(spark):
    rows = mixing.mix(odd_documents(spark)).collect()
    assert len(rows) == len(ODD_TEXTS)
    sizes = Counter()
    for _, text, source in ODD_TEXTS:
        sizes[source] += len(words_of(text))
    targets = plain_targets(sizes)
    assert {r.source: r.target for r in rows} == pytest.approx(targets)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.emit(odd_documents(spark)).columns == odd_documents(spark).columns
    assert mixing.mix(no_documents(spark)).count() == 0
    assert mixing.emit(no_documents(spark)).count() == 0
