"""Components against union-find."""

from __future__ import annotations

import random

import pytest
from helpers import Groups

from wardbook.llm.components import component_labels


def check(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in component_labels(frame).collect()}
    groups = Groups({n for e in edges if e[0] != e[1] for n in e})
    for a, b in edges:
        if a != b:
            groups.join(a, b)
    assert found == {n: groups.find(n) for n in groups.parent}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    check(spark, [(draw.randrange(120), draw.randrange(120)) for _ in range(90)])


def test_path_star_loop_and_nothing(spark):
    check(spark, [(i, i + 1) for i in range(60)])
    check(spark, [(0, i) for i in range(1, 200)] + [(7, 7), (3, 0)])
    check(spark, [])
