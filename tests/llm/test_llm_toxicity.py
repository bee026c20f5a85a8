"""Toxicity: lexicon matches by edit distance, context, and held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import TESTDATA
from helpers import ODD_TEXTS, no_documents, odd_documents

from wardbook.llm import toxicity

SF = str(TESTDATA).replace("sf0.001", "sf0.1")


def edits(a, b):
    """Letters put in, left out or changed, and swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def plain_match(word, terms):
    best = []
    for number, term in enumerate(terms):
        letters = term.rstrip("*")
        heads = [word[:k] for k in range(len(word) + 1)] if term.endswith("*") else [word]
        gap = min(edits(h, letters) for h in heads)
        if gap <= toxicity.allowed_edits(letters):
            best.append((gap, number))
    return min(best)[::-1] if best else None


def test_lexicon_matches_are_those_by_edit_distance():
    draw = random.Random(3)
    terms = ["abcab", "abc*", "bcabca*", "ca", "ab*", "abcabc", "cabba*"]
    long = ["abcdabcd", "dcbaabcdd*", "cabdcabda", "bbbbdddd", "acbd*"]
    for letters, most, lexicon in (
        ("abc", 10, toxicity.Lexicon(terms)),
        ("abcd", 12, toxicity.Lexicon(long)),
    ):
        for _ in range(4000):
            word = "".join(draw.choices(letters, k=draw.randrange(1, most)))
            if draw.random() < 0.5:
                word = list(draw.choice(lexicon.terms).rstrip("*"))
                for _ in range(draw.randrange(3)):
                    at = draw.randrange(len(word))
                    word[at : at + 2] = draw.choice([word[at : at + 2][::-1], [], ["a"], ["b", *word[at : at + 2]]])
                    word = word or ["a"]
                word = "".join(word)
            assert lexicon.match(word) == plain_match(word, lexicon.terms), word


def test_misspellings():
    lexicon = toxicity.Lexicon(["idiot", "scum", "disgusting"])
    found = {w: lexicon.match(w) for w in ("idoit", "disgutsing", "dissgustng", "disgusting", "sucm", "scun")}
    assert found == {
        "idoit": (0, 1), "disgutsing": (2, 1), "dissgustng": (2, 2), "disgusting": (2, 0),
        "sucm": None, "scun": None,
    }


def test_no_term_is_left_out_for_number():
    """Three thousand terms that each mark toxic texts alone are all in the lexicon."""
    words = [f"term{a}{b}{c}" for a in "abcdefghijklmno" for b in "abcdefghijklmn" for c in "abcdefghijklmno"][:3000]
    lexicon = toxicity.Lexicon(words)
    assert all(lexicon.match(w) == (i, 0) for i, w in enumerate(words))
    assert not hasattr(toxicity, "MAX_TERMS")


def test_full_caches_are_emptied(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 3)
    lexicon = toxicity.Lexicon(["idiot", "scu*"])
    words = ["idiot", "idoit", "idio", "scum", "scurry", "sc", "idiots", "xdiot"] * 3
    assert [lexicon.match(w) for w in words] == [plain_match(w, lexicon.terms) for w in words]


def test_many_words_against_many_terms():
    """Words that hardly repeat, against terms that may be misspelled in two places."""
    draw = random.Random(5)
    made = ["".join(draw.choices("etaoinshrdlu", k=draw.randrange(8, 12))) for _ in range(30_000)]
    made = list(dict.fromkeys(made))
    lexicon = toxicity.Lexicon(made[:2000])
    began = time.process_time()
    for i in range(0, len(made), 2000):
        toxicity.measures(" ".join(made[i : i + 2000]), lexicon, np.ones(2000))
    # A second or so; walking all of them letter by letter took more than a minute.
    assert time.process_time() - began < 15
    for word in made[:5] + made[-10:]:
        assert lexicon.match(word) == plain_match(word, lexicon.terms), word


def test_long_terms_and_stems():
    draw = random.Random(7)
    terms = ["".join(draw.choices("abcd", k=k)) for k in (15, 16, 17, 18, 24)]
    terms += ["".join(draw.choices("abcd", k=k)) + "*" for k in (9, 10, 11, 12, 17)]
    longest = "".join(draw.choices("abcd", k=1200))
    lexicon = toxicity.Lexicon([*terms, longest])
    words = []
    for _ in range(150):
        word = list(draw.choice(terms).rstrip("*"))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word))
            word[at : at + 2] = draw.choice([word[at : at + 2][::-1], [], ["a"], ["b", *word[at : at + 2]]])
        words.append("".join(word) + draw.choice(["", "", "ab"]))
    found = lexicon.read(toxicity._code_points(" ".join(words)))
    own = [None if t < 0 else (t, e) for t, e in zip(found.term.tolist(), found.edits.tolist(), strict=True)]
    assert own == [plain_match(word, terms) for word in words]
    assert lexicon.match(longest) == (len(terms), 0)
    assert lexicon.match(longest[:700] + longest[702:]) == (len(terms), 2)
    assert lexicon.match(longest[:500] + "x" + longest[500:700] + longest[702:]) is None


def plain_terms(text):
    words = {w for w in re.findall(r"\w+", text.lower()) if len(w) >= 3}
    return words | {w[:k] + "*" for w in words for k in toxicity.STEM_LENGTHS if len(w) > k}


def test_terms_are_counted_before_they_are_sent(monkeypatch):
    texts = ["idiot idiot house", "the idiot", "", "house of cards", "ΟΔΟΣ, İdiot-idiotic", "a_b " + "x" * 1500] * 3
    labels, halves = [1, 0, 0, 0, 1, 1] * 3, [0, 1, 0, 1, 1, 0] * 3
    batch = pa.RecordBatch.from_pydict({"text": texts, "label": labels, "half": halves})
    plain = Counter(
        (term, ("clean", "toxic")[label] + str(half))
        for text, label, half in zip(texts, labels, halves, strict=True)
        for term in plain_terms(text)
    )
    terms = {term for term, _ in plain}
    for most in (toxicity.CHUNK_LETTERS, 20):
        monkeypatch.setattr(toxicity, "CHUNK_LETTERS", most)
        sent = [row for part in toxicity.counted_terms(iter([batch, batch])) for row in part.to_pylist()]
        found = Counter()
        for row in sent:
            found.update({(row["term"], kind): row[kind] for kind in toxicity.CLASSES if row[kind]})
        assert found == {key: 2 * n for key, n in plain.items()}
        # A term goes out once for all texts that are read together, not once for each text.
        assert len(sent) == 2 * len(terms) if most > 20 else len(sent) > 2 * len(terms)


def plain_measures(text, lexicon, strengths):
    """The measures word by word."""
    lowered = text.lower()
    words, spans = re.findall(r"\w+", lowered), [m.span() for m in re.finditer(r"\w+", lowered)]
    abuse = misspelled = quoted = address = 0
    best, total = [0.0, 0.0], 0.0
    for i, hit in enumerate(map(lexicon.match, words)):
        if not hit:
            continue
        low, high = max(0, i - toxicity.WINDOW), min(len(words), i + toxicity.WINDOW + 1)
        near = set(words[low:i] + words[i + 1 : high])
        sides = lowered[spans[low][0] : spans[i][0]], lowered[spans[i][1] : spans[high - 1][1]]
        strength = float(strengths[hit[0]])
        if near & toxicity.REPORTING or all(set(side) & set("\"“”„«»‘‹›") for side in sides):
            quoted += 1
        elif hit[1]:
            misspelled, best[1] = misspelled + 1, max(best[1], strength)
        else:
            abuse, total, best[0] = abuse + 1, total + strength, max(best[0], strength)
        address += bool(near & toxicity.ADDRESS)
    logs = [math.log1p(x) for x in (abuse, misspelled, quoted, address, total, abuse + misspelled)]
    flags = min(abuse, 1.0), min(misspelled, 1.0)
    share = 1 + math.log1p(len(words))
    return [1.0, flags[0], logs[0], best[0] / 4, flags[1], logs[1], best[1] / 4, *logs[2:5], 10 * logs[5] / share]


def test_texts_are_measured_alike_alone_and_together():
    draw = random.Random(11)
    lexicon, strengths = toxicity.Lexicon(["idiot", "disgusting", "scu*", "insulto"]), np.array([4.0, 3.3, 2.7, 1.1])
    bits = ["idiot", "id1ot", "DISGUSTING", "disgutsing", "scums", "insulto", "you", "said", "\"", "“", "»", "the", "a_b"]
    bits += ["house,", "İdiot", "ΟΔΟΣ", "\x85", "日本", "\U0001f600", "x" * 1500, "-"]
    texts = ["".join(x + draw.choice([" ", " ", "\n", "-", ""]) for x in draw.choices(bits, k=draw.randrange(40)))
             for _ in range(400)]
    texts += ["", " ", "idiot", "\"idiot\"", "\"a idiot b\" c"]
    plain = [plain_measures(t, lexicon, strengths) for t in texts]
    assert toxicity._measures(texts, lexicon, strengths) == plain
    assert [toxicity.measures(t, lexicon, strengths) for t in texts] == plain


def test_quotation_is_told_from_abuse():
    lexicon, strengths = toxicity.Lexicon(["idiot"]), np.array([4.0])
    abuse = toxicity.measures("you are an idiot indeed", lexicon, strengths)
    quoted = toxicity.measures('the "idiot" was printed', lexicon, strengths)
    reported = toxicity.measures("they said idiot to us", lexicon, strengths)
    misspelt = toxicity.measures("you are an id1ot indeed", lexicon, strengths)
    assert abuse[1] == 1 and quoted[1] == reported[1] == misspelt[1] == 0
    assert quoted[7] == reported[7] > 0 and misspelt[4] == 1


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rated = toxicity.rate(docs, labels)
    rows = rated.join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    # Some labels are noise: about one toxic document in twenty shows nothing of it.
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.01
    assert rated.count() == docs.count()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (1, None)], "doc_id long, toxic int")
    rows = toxicity.rate(docs, labels).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    none = toxicity.rate(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.rate(no_documents(spark), labels).count() == 0
