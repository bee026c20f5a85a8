"""Packed ids against the tokenizer itself."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import TESTDATA
from helpers import ODD_TEXTS, no_documents, odd_documents

from wardbook.llm import packing
from wardbook.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


def unpacked(rows):
    """``doc_id -> ids`` of pieces, which must be gapless powers of two."""
    found = {}
    for row in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = found.setdefault(row.doc_id, [])
        piece = np.frombuffer(row.ids, dtype="<u4").tolist()
        assert row.start == len(ids) and row.length == len(piece) <= packing.MAX_LENGTH
        assert row.length == 1 << row.bucket and row.offset == 0
        ids += piece
    return found


def test_whole_table_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    found = unpacked(rows)
    for r in docs.collect():
        assert found[r.doc_id] == tokenizer(r.text) + [packing.END_ID]


def test_odd_characters_give_the_tokenizers_ids(tokenizer):
    draw = random.Random(1)
    parts = list("aAzZéÉßüñ'’.,!#09²½́İſΣσς日本  \x1c\x85\x0b\x00 \t\n\r|_-")
    parts += ["'s", "'LL", "can't", "<|endoftext|>", " the ", "Straße", "…", "ﬁ", "ŉ", "İI", "\U0001f600"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(3000)]
    words = packing.WordTokenizer(tokenizer_path())
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer(text), ascii(text)


def test_full_cache_is_emptied(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    words = packing.WordTokenizer(tokenizer_path())
    for texts in (["a b c d"], ["e f g", "a b"], ["h " * 3 + "i j k l m n"]):
        for text, ids in zip(texts, words.ids(texts), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer(text)


def test_a_word_is_parted_once_a_call(monkeypatch, tokenizer):
    parted = []
    rule = packing._PARTS

    class Counting:
        def findall(self, text):
            parted.append(text)
            return rule.findall(text)

    monkeypatch.setattr(packing, "_PARTS", Counting())
    words = packing.WordTokenizer(tokenizer_path())
    texts = ["it's done, it's done.\n" * 500, "", "\u2026 can't! " * 500, "it's done, can't!"]
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer(text)
    assert sum(map(len, parted)) <= len("it's done, done. can't!")


def test_only_words_with_odd_characters_go_through_whole(tokenizer):
    sent = []
    words = packing.WordTokenizer(tokenizer_path())
    whole = words._whole

    class Listening:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    words._whole = Listening()
    text = "Plain words, \u201cquoted\u201d ones\x0band\x0cmore."
    [ids] = words.ids([text])
    assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer(text)
    assert sent == ["\u201cquoted\u201d"]


def test_long_words_are_not_kept(tokenizer):
    texts = ["ACGT" * 500, "acgt" * 500 + " a", "日本" * 500, "x," * 500 + "ACGT" * 500, "acgt" * 500]
    words = packing.WordTokenizer(tokenizer_path())
    for _ in range(2):
        for text, ids in zip(texts, words.ids(texts), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer(text)
    assert max(map(len, words._ids)) <= 32


def test_lengths():
    assert packing.pieces(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.pieces(2048, 2048) == [2048]
    assert packing.pieces(1, 2048) == [1]


def test_odd_rows(spark, tokenizer):
    rows = packing.pack(odd_documents(spark), tokenizer_path()).collect()
    ids = {i: t for i, t, _ in ODD_TEXTS}
    found = unpacked([r for r in rows if r.doc_id in ids and r.doc_id not in (5, None)])
    assert found[1] == found[2] == found[3] == [1]
    assert found[6] == tokenizer(ids[6]) + [1] and found[7] == tokenizer(ids[7]) + [1]
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * (len(tokenizer("one")) + 1)
    assert any(r.doc_id is None for r in rows)
    assert packing.pack(no_documents(spark), tokenizer_path()).count() == 0
