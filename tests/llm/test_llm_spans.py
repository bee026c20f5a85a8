"""Removal of repeated spans against a table of all strings."""

from __future__ import annotations

import random

import numpy as np
import pytest
import zstandard
from conftest import TESTDATA
from helpers import ODD_TEXTS, no_documents, odd_documents

from wardbook.llm import spans


def plain(documents):
    """``id -> (n_bytes, n_removed, n_spans, kept)`` by remembering every string."""
    first = {}
    for doc_id, text in documents:
        data = (text or "").encode()
        for i in range(len(data) - spans.LENGTH + 1):
            string = data[i : i + spans.LENGTH]
            if doc_id is not None:
                first[string] = min(first.get(string, doc_id), doc_id)
    out = []
    for doc_id, text in documents:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - spans.LENGTH + 1):
            if doc_id is not None and first[data[i : i + spans.LENGTH]] < doc_id:
                gone[i : i + spans.LENGTH] = b"\x01" * spans.LENGTH
        edges = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), edges, kept))
    return sorted(out, key=repr)


def ours(docs):
    return sorted((tuple(map(_bytes, r)) for r in spans.remove_repeats(docs).collect()), key=repr)


def _bytes(value):
    return bytes(value) if isinstance(value, bytearray) else value


def test_whole_table(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert ours(docs) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_copies_edits_and_shards(spark, monkeypatch, seed):
    draw = random.Random(seed)
    # Small blocks, passes and arrays: strings meet across all of them.
    monkeypatch.setattr(spans, "ARRAY", 700)
    base = "".join(draw.choices("abc é", k=900))
    rows = []
    for i in draw.sample(range(1000), 40):
        at = draw.randrange(800)
        text = list(base[at : at + draw.randrange(300)])
        for _ in range(draw.randrange(3)):
            if text:
                text[draw.randrange(len(text))] = draw.choice("xyz\x00")
        rows.append((i, "".join(text) + draw.choice(["", base[:120], "tail" * 40])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours(docs) == plain(rows)


@pytest.mark.parametrize("hot", [1, 3, 20])
def test_hot_anchors(spark, monkeypatch, hot):
    draw = random.Random(hot)
    passage = "".join(draw.choices("abcdefgh", k=130))
    rows = []
    for i in range(120):
        around = ["".join(draw.choices("abcdefgh", k=draw.randrange(90))) for _ in range(2)]
        text = around[0] + draw.choice([passage, passage[:30], passage[50:], ""]) + around[1]
        rows.append((i if i % 17 else None, text + draw.choice(["", rows[i // 2][1] if rows else ""])))
    rows += rows[5:9]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(spans, "HOT", hot)
    assert ours(docs) == plain(rows)


def test_no_task_gets_all_strings_of_a_hot_anchor(spark, monkeypatch):
    draw = random.Random(5)
    passage = "".join(draw.choices("abcdefgh", k=100))
    # Characters of their own around it, so that each text has other strings at its edges.
    rows = [(i, chr(0x4E00 + i) * 14 + passage + chr(0x4E00 + i) * 14) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    judged = spans._judged

    def watched(group):
        """Fails where a task gets more than 40 strings around one gram; blocks send equal ones once."""
        met = {}
        for row in group.to_dict("records"):
            sizes = np.frombuffer(row["sizes"], dtype=np.uint8).astype(int)
            data = zstandard.ZstdDecompressor().decompress(row["strings"], max_output_size=1_000_000)
            for end, size, offset in zip(np.cumsum(sizes), sizes, row["offsets"], strict=True):
                gram = data[end - size + offset :][: spans.GRAM]
                met[gram] = met.get(gram, 0) + 1
        assert max(met.values()) <= 40
        return judged(group)

    monkeypatch.setattr(spans, "_judged", watched)
    monkeypatch.setattr(spans, "HOT", 40, raising=False)
    assert ours(docs) == plain(rows)


def test_passes_over_one_text_agree(monkeypatch):
    data = bytes(random.Random(1).choices(range(97, 101), k=5000))
    ends = np.array([1000, 1000, 1049, 5000])
    def windows(runs):
        return {
            (int(s) + i, int(s + o))
            for s, c, o in zip(runs.start, runs.count, runs.offset, strict=True)
            for i in range(int(c))
        }
    whole = windows(spans.runs_of(data, ends))
    monkeypatch.setattr(spans, "PASS", 333)
    assert windows(spans.runs_of(data, ends)) == whole
    assert len({w for w, _ in whole}) == len(whole) == 951 + 3902


def test_suffix_array_and_common_prefixes():
    draw = random.Random(2)
    strings = [bytes(draw.choices(b"ab", k=draw.randrange(50, 70))) for _ in range(60)]
    strings = list(dict.fromkeys(strings + [s[:-1] + b"c" for s in strings]))
    docs = np.array([draw.randrange(50) for _ in strings])
    least = {}
    for s, d in zip(strings, docs.tolist(), strict=True):
        for i in range(len(s) - spans.LENGTH + 1):
            w = s[i : i + spans.LENGTH]
            least[w] = min(least.get(w, d), d)
    found = spans.earliest(strings, docs)
    for s, own in zip(strings, found, strict=True):
        assert own.tolist() == [least[s[i : i + 50]] for i in range(len(s) - 49)]


@pytest.mark.parametrize("data", [b"ab\0\0", bytes(200), b"x\0\0y" * 30 + bytes(70), b"\0"])
def test_suffixes_that_end_in_nuls(data):
    order = spans.suffix_array(data, np.arange(len(data)))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_texts_that_end_in_nuls(spark):
    rows = [(i, f"{i:02d} before " + "\0" * (60 + i % 3)) for i in range(12)]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_odd_rows(spark):
    rows = [(i, t) for i, t, _ in ODD_TEXTS]
    assert ours(odd_documents(spark)) == plain(rows)
    assert ours(no_documents(spark)) == []
