"""Odd tables and plain Python versions for the tests of the operators."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, "one", "b"),
    (5, "one", "b"),
    (5, "one", "b"),
    (6, "the long text of words " * 4000, "é"),
    (None, "no number here", "b"),
    (7, "Überraschung! It’s a ſecret token = 'abcdefgh1234' 日本 \U0001f600", "c"),
]
SCHEMA = "doc_id long, text string, source string, score string, spans int, size int, rate int, first int"


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as results are."""
    rows = [(i, t, s, "x", 1, 2, 3, 4) for i, t, s in ODD_TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


class Groups:
    """Union-find, the plain version of components."""

    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a
