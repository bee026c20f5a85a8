"""Toxicity scores from a learned lexicon, misspellings and context."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.learning import held_out, labelled_rows, logistic
from wardbook.llm.shared import staged

CUT = 0.5
#: Words on either side of a hit that tell quotation from abuse.
WINDOW = 8
STEM_LENGTHS = range(3, 9)
#: Words a worker process remembers; letters of texts it looks at at once.
CACHE_WORDS = 2_000_000
CHUNK_LETTERS = 4_000_000
#: Longer terms, and stems, are looked up by so many first letters.
LONG = 16
HEAD = 10
_WORDS_AT_ONCE = 8192
_LETTERS_AT_ONCE = 1_000_000
_BITS_A_KEY = 128
_NONE = 1 << 62
#: Longer words are told apart by a digest.
_HASHED = 1000
_WORD = re.compile(r"\w+")
_QUOTES = "\"“”„«»‘‹›"

# Words of four languages that report speech, and that address someone.
REPORTING = frozenset(
    "said says wrote writes called quoted quote word term insult sagte schrieb nannte wort "
    "zitat beleidigung dit écrit appelé mot citation insulte dijo escribió llamó palabra cita "
    "insulto".split()
)
ADDRESS = frozenset("you your yours du dich dein dir tu te toi vous votre tú ti usted vosotros".split())
#: What a word may be in a text, as bits.
REPORTS, ADDRESSES = 1, 2


def allowed_edits(term: str) -> int:
    """Edits a term may be away from a word: none below five letters, one below eight, then two.

    An edit is a letter put in, left out or changed, or two neighbours swapped.
    """
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


_BASE = 0xC2B2AE3D27D4EB4F
_POWERS = np.array([pow(_BASE, i, 2**64) for i in range(_HASHED)], dtype=np.uint64)
_DOWN = np.uint64(pow(_BASE, -1, 2**64))
_DOWN2 = np.uint64(pow(_BASE, -2, 2**64))
_BITS = np.array([1 << i for i in range(8)], dtype=np.uint8)
_LETTER, _QUOTE = 1, 2


@cache
def _characters() -> np.ndarray:
    """By code point: whether it is a letter of words or a quotation mark."""
    found = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for run in _WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        found[run.start() : run.end()] = _LETTER
    found[[ord(mark) for mark in _QUOTES]] = _QUOTE
    return found


@cache
def _values() -> np.ndarray:
    """A number of 64 bits for each code point, as if by chance."""
    found = np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(factor)
    return found ^ (found >> np.uint64(32))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _bounds(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words among code points start, and how long they are."""
    inside = np.concatenate([[False], _characters()[letters] == _LETTER, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2] - turns[::2]


def _hashes(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of 64 bits for each word; those of ``_HASHED`` letters or fewer are sums over letters."""
    found = np.zeros(len(starts), dtype=np.uint64)
    values = _values()
    for low in range(0, len(starts), _WORDS_AT_ONCE):
        some = slice(low, low + _WORDS_AT_ONCE)
        size = np.minimum(sizes[some], _HASHED)
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        summands = values[letters[np.repeat(starts[some], size) + place]] * _POWERS[place]
        found[some] = np.add.reduceat(summands, first)
    for i in np.flatnonzero(sizes > _HASHED).tolist():
        word = letters[starts[i] : starts[i] + sizes[i]]
        found[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest())
    return found


def _columns(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """The first letters of words, a row for each letter; zero behind a word's end."""
    at = np.arange(length)[:, None]
    found = letters[np.minimum(starts + at, len(letters) - 1)]
    found[at >= sizes] = 0
    return found


def _rising(codes: np.ndarray) -> np.ndarray:
    """Hashes of all beginnings of words of one length, from none on; a row for each beginning."""
    sums = np.zeros((len(codes) + 1, codes.shape[1]), dtype=np.uint64)
    np.cumsum(_values()[codes] * _POWERS[: len(codes), None], axis=0, out=sums[1:])
    return sums


def _without(sums: np.ndarray, length: int, left_out: int, last: bool) -> Iterator[np.ndarray]:
    """Hashes of the first ``length`` letters with ``left_out`` of them left out, in all ways.

    ``sums`` is from ``_rising``. The last letter is left out only if ``last``.
    """
    end, until = sums[length], length if last else length - 1
    if left_out == 0:
        yield end[None]
    elif left_out == 1:
        yield sums[:until] + (end - sums[1 : until + 1]) * _DOWN
    else:
        for p in range(until - 1):
            between = (sums[p + 1 : until] - sums[p + 1]) * _DOWN
            yield sums[p] + between + (end - sums[p + 2 : until + 1]) * _DOWN2


class _Near:
    """Finds the terms that may be a few edits from a word, or with ``heads`` from its beginning.

    Where a term is within k edits of a word, up to k letters left out of each leave the same
    letters. The hashes of what terms leave are kept in order, and in a bitmap that most
    hashes of words are not in. With ``heads`` a term's first letters stand for it.
    """

    def __init__(self, terms: list[tuple[int, str]], heads: bool):
        self._heads = heads
        keys, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        #: Letters of a word and how many of them to leave out.
        self._ways: set[tuple[int, int]] = set()
        same: dict[tuple[int, int], list[tuple[int, str]]] = {}
        for number, letters in terms:
            first = letters[:HEAD] if heads else letters
            same.setdefault((len(first), allowed_edits(letters)), []).append((number, first))
        for (length, most), group in same.items():
            sums = _rising(_code_points("".join(letters for _, letters in group)).reshape(-1, length).T)
            for left_out in range(most + 1):
                self._ways |= {(length - left_out + b, b) for b in range(most + 1)}
                for hashes in _without(sums, length, left_out, last=True):
                    keys.append(hashes.ravel())
                    numbers.append(np.tile([number for number, _ in group], len(hashes)))
        found = np.concatenate(keys)
        order = np.argsort(found, kind="stable")
        self._keys, self._numbers = found[order], np.concatenate(numbers)[order]
        bits = max(16, (_BITS_A_KEY * len(found)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._map = np.zeros(2 ** (bits - 3), dtype=np.uint8)
        place = (found >> self._shift).view(np.int64)
        np.bitwise_or.at(self._map, place >> 3, _BITS[place & 7])
        #: Letters of the longest word, or beginning of one, that is looked up.
        self.longest = max((length for length, _ in self._ways), default=0)

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and of terms, each pair once; the words are all of one length."""
        length, count = codes.shape
        hashes, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        ways = [w for w in self._ways if (w[0] <= length if self._heads else w[0] == length)]
        sums = _rising(codes) if ways else None
        for first, left_out in ways:
            # A beginning whose last letter is left out is a shorter beginning.
            for some in _without(sums, first, left_out, last=not self._heads):
                place = (some >> self._shift).view(np.int64)
                hit = np.flatnonzero(self._map[place >> 3] & _BITS[place & 7])
                hashes.append(some.ravel()[hit])
                words.append(hit % count)
        wanted, word = np.concatenate(hashes), np.concatenate(words)
        low = np.searchsorted(self._keys, wanted, "left")
        many = np.searchsorted(self._keys, wanted, "right") - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.sort(np.repeat(word, many) << 32 | self._numbers[at])
        both = both[np.diff(both, prepend=-1) > 0]
        return both >> 32, both & 0xFFFFFFFF


def _edits(a: np.ndarray, b: np.ndarray, own: np.ndarray, ends: np.ndarray, stem: bool) -> np.ndarray:
    """Edits between words and terms, pair by pair; above two they count as three or more.

    ``a`` and ``b`` have a row for each letter of the words, ``own`` long, and of the terms,
    ``ends`` long. With ``stem`` the nearest beginning of the word counts. Only beginnings
    within two letters of each other's length are looked at.
    """
    count, width, longest = a.shape[1], len(a), len(b)
    same = [[a[i] == b[j] if 0 <= j < longest else None for j in range(i - 3, i + 4)] for i in range(width)]
    most = np.uint8(9)
    best = np.full(count, most)
    before: list[np.ndarray] = []
    # Place d of row i holds the edits between i letters of the word and i + d - 2 of the term.
    last = [np.full(count, d - 2 if d >= 2 else most, dtype=np.uint8) for d in range(5)]
    for i in range(width + 1):
        if i:
            row = []
            for d in range(5):
                j = i + d - 2
                if j < 0 or j > longest:
                    row.append(np.full(count, most))
                    continue
                if j == 0:
                    value = np.full(count, np.uint8(i))
                else:
                    value = last[d] + ~same[i - 1][d + 1]
                    if d:
                        np.minimum(value, row[d - 1] + np.uint8(1), out=value)
                if d < 4:
                    np.minimum(value, last[d + 1] + np.uint8(1), out=value)
                if i > 1 and j > 1:
                    swapped = same[i - 1][d] & same[i - 2][d + 2]
                    np.minimum(value, before[d] + np.uint8(1), out=value, where=swapped)
                row.append(np.minimum(value, most, out=value))
            before, last = last, row
        here = (own >= i) if stem else (own == i)
        for d in range(5):
            np.minimum(best, last[d], out=best, where=here & (ends == i + d - 2))
    return best


class Reading(NamedTuple):
    """The words of a text in order: where they start, the nearest term or -1, its edits, their kind."""

    starts: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    kind: np.ndarray


class Lexicon:
    """Terms that words match exactly or misspelled; a term ending in ``*`` is a stem.

    Words are looked up many at a time and each different one once. What letters left out of
    words and terms have in common names the few terms a word may be near; the edits to
    those are counted.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        letters = [t.rstrip("*") for t in terms]
        self._letters = _code_points("".join(letters))
        self._sizes = np.array([len(own) for own in letters], dtype=np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._allowed = np.array([allowed_edits(own) for own in letters], dtype=np.int64)
        stems = [x for x in enumerate(letters) if terms[x[0]].endswith("*")]
        whole = [x for x in enumerate(letters) if not terms[x[0]].endswith("*")]
        self._stems = _Near(stems, heads=True)
        self._short = _Near([x for x in whole if len(x[1]) <= LONG], heads=False)
        self._long = _Near([x for x in whole if len(x[1]) > LONG], heads=True)
        #: Hashes of known words in order, and by their places what a reading has of them.
        self._known = np.zeros(0, np.uint64)
        self._term, self._edits = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        listed = sorted(REPORTING | ADDRESS)
        size = np.array([len(word) for word in listed])
        kinds = [REPORTS * (word in REPORTING) | ADDRESSES * (word in ADDRESS) for word in listed]
        hashes = _hashes(_code_points("".join(listed)), np.cumsum(size) - size, size)
        order = np.argsort(hashes)
        self._listed, self._kinds = hashes[order], np.array(kinds, np.uint8)[order]

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term's number and its edits, or None."""
        found = self.read(_code_points(word))
        hit = found.term[:1] >= 0
        return (int(found.term[0]), int(found.edits[0])) if hit.any() else None

    def read(self, letters: np.ndarray) -> Reading:
        """The words among ``letters``, code points of lower-cased text."""
        starts, sizes = _bounds(letters)
        own, first, back = np.unique(
            _hashes(letters, starts, sizes), return_index=True, return_inverse=True
        )
        if len(self._known) > CACHE_WORDS:
            self._known, self._term, self._edits = self._known[:0], self._term[:0], self._edits[:0]
        at, known = _places(self._known, own)
        new = first[~known]
        term, edits = np.zeros(len(own), np.int32), np.zeros(len(own), np.uint8)
        term[known], edits[known] = self._term[at[known]], self._edits[at[known]]
        term[~known], edits[~known] = self._nearest(letters, starts[new], sizes[new])
        hashes = np.concatenate([self._known, own[~known]])
        order = np.argsort(hashes, kind="stable")
        self._known = hashes[order]
        self._term = np.concatenate([self._term, term[~known]])[order]
        self._edits = np.concatenate([self._edits, edits[~known]])[order]
        at, listed = _places(self._listed, own)
        kind = np.zeros(len(own), np.uint8)
        kind[listed] = self._kinds[at[listed]]
        return Reading(starts, term[back], edits[back], kind[back])

    def _nearest(
        self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest term, the first of equally near ones or -1, and its edits."""
        #: Edits and number of the best term yet, as one number.
        best = np.full(len(starts), _NONE)

        def judge(near: _Near, of: np.ndarray, length: int, stem: bool = False) -> None:
            """Lower ``best`` of the words ``of`` by the terms near their first ``length`` letters."""
            for low in range(0, len(of) if length else 0, _WORDS_AT_ONCE):
                some = of[low : low + _WORDS_AT_ONCE]
                word, term = near.pairs(_columns(letters, starts[some], sizes[some], length))
                word, power = some[word], np.frexp(self._sizes[term])[1]
                # Lengths within a factor of two together, so that few places are empty.
                for same in np.unique(power):
                    w, t = word[power == same], term[power == same]
                    longest = int(self._sizes[t].max())
                    step = max(1, _LETTERS_AT_ONCE // longest)
                    for part in range(0, len(w), step):
                        compare(w[part : part + step], t[part : part + step], longest, stem)

        def compare(w: np.ndarray, t: np.ndarray, longest: int, stem: bool) -> None:
            edits = _edits(
                _columns(letters, starts[w], sizes[w], longest + 2),
                _columns(self._letters, self._starts[t], self._sizes[t], longest),
                sizes[w],
                self._sizes[t],
                stem,
            ).astype(np.int64)
            fits = edits <= self._allowed[t]
            np.minimum.at(best, w[fits], edits[fits] << 32 | t[fits])

        by_length = np.argsort(sizes, kind="stable")
        ends = np.cumsum(np.bincount(np.minimum(sizes, LONG + 3), minlength=LONG + 4))
        for length in range(1, LONG + 3):
            of = by_length[ends[length - 1] : ends[length]]
            if length <= self._short.longest:
                judge(self._short, of, length)
            if length < self._stems.longest:
                judge(self._stems, of, length, stem=True)
        judge(self._stems, np.flatnonzero(sizes >= self._stems.longest), self._stems.longest, stem=True)
        judge(self._long, np.flatnonzero(sizes > LONG - 2), self._long.longest)
        return np.where(best < _NONE, best & 0xFFFFFFFF, -1), (best >> 32) & 0xFF


def _places(sorted_numbers: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted numbers are or would be, and whether they are there."""
    at = np.searchsorted(sorted_numbers, wanted)
    found = np.zeros(len(wanted), dtype=bool)
    inside = at < len(sorted_numbers)
    found[inside] = sorted_numbers[at[inside]] == wanted[inside]
    return at, found


def measures(text: str, lexicon: Lexicon, strengths: np.ndarray) -> list[float]:
    """What the hits of one whole text say, abusive and quoted ones apart."""
    return _measures([text], lexicon, strengths)[0]


def _measures(texts: list[str], lexicon: Lexicon, strengths: np.ndarray) -> list[list[float]]:
    """The measures of each of the texts."""
    lowered = [text.lower() for text in texts]
    letters = _code_points(" ".join([*lowered, ""]))
    read = lexicon.read(letters)
    ends = np.searchsorted(read.starts, np.cumsum([len(text) + 1 for text in lowered]))
    counts = np.diff(ends, prepend=0)
    at = np.flatnonzero(read.term >= 0)
    of = np.searchsorted(ends, at, "right")
    low = np.maximum(at - WINDOW, (ends - counts)[of])
    high = np.minimum(at + WINDOW + 1, ends[of])

    def near(kind: int) -> np.ndarray:
        """Whether a word of the kind is in the window, beside the hit itself."""
        own = (read.kind & kind) > 0
        upto = np.concatenate([[0], np.cumsum(own)])
        return upto[high] - upto[low] - own[at] > 0

    quotes = np.flatnonzero(_characters()[letters] == _QUOTE)
    # Quotation marks before a hit, before its window's first word, and before its last one.
    marks, marks_low, marks_high = (
        np.searchsorted(quotes, read.starts[words]) for words in (at, low, high - 1)
    )
    quoted = near(REPORTS) | ((marks > marks_low) & (marks_high > marks))
    wrong = ~quoted & (read.edits[at] > 0)
    plain = ~quoted & ~wrong
    strength = strengths[read.term[at]]
    best = np.zeros((2, len(texts)))
    for row, which in zip(best, (plain, wrong), strict=True):
        np.maximum.at(row, of[which], strength[which])
    sums = [np.bincount(of[x], minlength=len(texts)) for x in (plain, wrong, quoted, near(ADDRESSES))]
    totals = np.bincount(of[plain], strength[plain], minlength=len(texts))
    columns = (counts, *sums, *best, totals)
    return [_summary(*row) for row in zip(*(c.tolist() for c in columns), strict=True)]


def _summary(
    words: int, abuse: int, misspelled: int, quoted: int, address: int, best: float, second: float, total: float
) -> list[float]:
    share = 1 + math.log1p(words)
    return [
        1.0,
        min(abuse, 1.0),
        math.log1p(abuse),
        best / 4,
        min(misspelled, 1.0),
        math.log1p(misspelled),
        second / 4,
        math.log1p(quoted),
        math.log1p(address),
        math.log1p(total),
        10 * math.log1p(abuse + misspelled) / share,
    ]


WIDTH = 11


@dataclass(frozen=True)
class Model:
    """Terms with their strengths, and the weights of a text's measures."""

    terms: tuple[str, ...]
    strengths: tuple[float, ...]
    weights: tuple[float, ...]


_lexicons: dict[tuple[str, ...], Lexicon] = {}
#: Of the lexicons used last.
KEPT_LEXICONS = 2


def _lexicon(terms: tuple[str, ...]) -> Lexicon:
    if terms not in _lexicons:
        while len(_lexicons) >= KEPT_LEXICONS:
            _lexicons.pop(next(iter(_lexicons)))
        _lexicons[terms] = Lexicon(list(terms))
    return _lexicons[terms]


def _measured(texts: list[str | None], model: Model) -> np.ndarray:
    lexicon, strengths = _lexicon(model.terms), np.array(model.strengths)
    rows = [row for part in _parts(texts) for row in _measures(part, lexicon, strengths)]
    return np.array(rows).reshape(-1, WIDTH)


def _parts(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, ``CHUNK_LETTERS`` at a time or one by one if longer; nulls are empty."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text or "") > CHUNK_LETTERS:
            yield part
            part, size = [], 0
        part.append(text or "")
        size += len(text or "")
    if part:
        yield part


CLASSES = ("toxic0", "clean0", "toxic1", "clean1")


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts of each half have each term; a term may come in several parts.

    Terms are the words of three letters and more, and their beginnings as stems.
    """
    for batch in batches:
        label, half = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("label", "half"))
        kinds, done = 2 * half + 1 - label, 0
        for part in _parts(batch.column("text").to_pylist()):
            for terms, counts in _term_counts(part, kinds[done : done + len(part)]):
                columns = [pa.array(terms, pa.string()), *map(pa.array, np.ascontiguousarray(counts.T))]
                yield pa.RecordBatch.from_arrays(columns, names=["term", *CLASSES])
            done += len(part)


def _term_counts(texts: list[str], kinds: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """Terms of texts, and for each of them how many of the texts of each kind have it."""
    lowered = [text.lower() for text in texts]
    joined = " ".join([*lowered, ""])
    letters = _code_points(joined)
    starts, sizes = _bounds(letters)
    starts, sizes = starts[sizes >= STEM_LENGTHS[0]], sizes[sizes >= STEM_LENGTHS[0]]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), starts, "right")

    def count(term: np.ndarray, text: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a text and a term, each once, and the counts of the terms."""
        both = np.sort(text << 32 | term)
        both = both[np.diff(both, prepend=-1) > 0]
        text, term = both >> 32, both & 0xFFFFFFFF
        found = np.bincount(term * len(CLASSES) + kinds[text], minlength=number * len(CLASSES))
        return text, term, found.reshape(-1, len(CLASSES))

    _, first, word = np.unique(_hashes(letters, starts, sizes), return_index=True, return_inverse=True)
    starts, sizes = starts[first], sizes[first]
    text, word, counts = count(word, text, len(first))
    places = zip(starts.tolist(), (starts + sizes).tolist(), strict=True)
    yield [joined[low:high] for low, high in places], counts
    for k in STEM_LENGTHS:
        longer = np.flatnonzero(sizes > k)
        heads = _hashes(letters, starts[longer], np.full(len(longer), k))
        stem_of = np.full(len(starts), -1)
        _, first, stem_of[longer] = np.unique(heads, return_index=True, return_inverse=True)
        stems, has = stem_of[word], stem_of[word] >= 0
        counts = count(stems[has], text[has], len(first))[2]
        yield [joined[low : low + k] + "*" for low in starts[longer[first]].tolist()], counts


def chance_strength(terms: int) -> float:
    """The strength that about one of so many terms reaches by chance."""
    return math.sqrt(2 * math.log(max(terms, 1)))


def pick_terms(
    counts: list[tuple[str, int, int]], toxic: int, clean: int, least: float = 0.0
) -> dict[str, float]:
    """The terms of toxic texts with their strength; where a longer term does as well, that.

    ``counts`` holds term, toxic and clean texts that have it. A term needs three toxic
    texts and 12 times the clean ones' share. Its strength is the root of the evidence
    that it is no chance find, so terms of few texts count for less, and those below
    ``least`` not at all.
    """
    share = max(toxic, 1) / max(toxic + clean, 1)
    seen = {term: t for term, t, _ in counts}
    strength: dict[str, float] = {}
    for term, t, c in counts:
        if t >= 3 and (t + 0.5) * (clean + 1) >= 12 * (c + 0.5) * (toxic + 1):
            strength[term] = math.sqrt(max(0.0, 2 * t * math.log(t / (t + c) / share)))
    kept: list[str] = []
    longer: dict[str, int] = {}
    for term in sorted(strength, key=lambda x: (-len(x.rstrip("*")), x.endswith("*"), x)):
        letters = term.rstrip("*")
        if term.endswith("*") and longer.get(letters, 0) >= 0.9 * seen[term]:
            continue
        kept.append(term)
        for k in STEM_LENGTHS:
            if k <= len(letters):
                longer[letters[:k]] = max(longer.get(letters[:k], 0), seen[term])
    stems = {t[:-1] for t in kept if t.endswith("*")}

    def covered(term: str) -> bool:
        letters = term.rstrip("*")
        shorter = any(letters[:k] in stems for k in STEM_LENGTHS if k < len(letters))
        return shorter or (not term.endswith("*") and term in stems)

    own = [t for t in kept if strength[t] >= least and not covered(t)]
    return {t: strength[t] for t in sorted(own)}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The lexicon from all labelled documents, the weights by halves of them.

    The weights are fitted to what each half's texts show under the lexicon of the other
    half, so a term's chance finds do not count for it. Texts are counted once each. Terms
    are counted on the executors; the driver gets those that three or more toxic texts
    and few clean ones share and that are no chance finds.
    """
    texts = labelled_rows(docs, labels, "toxic").select("text", "label").distinct()
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    rows = staged(texts.withColumn("half", half), "toxicity-texts")

    label, second = F.col("label"), F.col("half")
    sums = (
        F.sum(label * (1 - second)).alias("toxic0"),
        F.sum((1 - label) * (1 - second)).alias("clean0"),
        F.sum(label * second).alias("toxic1"),
        F.sum((1 - label) * second).alias("clean1"),
    )
    whole = [v or 0 for v in rows.agg(*sums).first()]
    toxic, clean = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    rate = (whole[0] + whole[2] + 1) / (whole[1] + whole[3] + 1)
    common = staged(
        rows.mapInArrow(counted_terms, "term string, " + ", ".join(f"{c} long" for c in CLASSES))
        .groupBy("term")
        .agg(*(F.sum(c).alias(c) for c in CLASSES))
        .where(toxic >= 3),
        "toxicity-terms",
    )
    least = chance_strength(common.count())
    # The strength of ``pick_terms``, with room for a rounding.
    strengths_of = [
        F.when(t > 0, 2 * t * F.ln(t / (t + c) / (max(a, 1) / max(a + b, 1))))
        for t, c, a, b in (
            (F.col("toxic0"), F.col("clean0"), whole[0], whole[1]),
            (F.col("toxic1"), F.col("clean1"), whole[2], whole[3]),
            (toxic, clean, whole[0] + whole[2], whole[1] + whole[3]),
        )
    ]
    strong = F.greatest(*strengths_of) >= least**2 - 1e-6
    counts = common.where((toxic + 0.5 >= 10 * rate * (clean + 0.5)) & strong).collect()
    halves = [
        pick_terms([(r.term, r[1 + i], r[2 + i]) for r in counts], whole[i], whole[i + 1], least)
        for i in (0, 2)
    ]
    picked = pick_terms(
        [(r.term, r.toxic0 + r.toxic1, r.clean0 + r.clean1) for r in counts],
        whole[0] + whole[2],
        whole[1] + whole[3],
        least,
    )
    plain = [Model(tuple(h), tuple(h.values()), (0.0,) * WIDTH) for h in halves]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column("half").to_pylist())
            texts = np.array(batch.column("text").to_pylist(), dtype=object)
            for i in (0, 1):
                rows = _measured(list(texts[own == i]), plain[1 - i]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").filter(pa.array(own == i)),
                        pa.array(rows, pa.list_(pa.float64())),
                    ],
                    names=["target", "features"],
                )

    terms_kept, strengths = tuple(picked), tuple(picked.values())
    if not sum(whole):
        return Model(terms_kept, strengths, (-1.0, *(0.0,) * (WIDTH - 1)))
    measured = staged(
        rows.mapInArrow(measure, "target int, features array<double>"), "toxicity-measures"
    )
    return Model(terms_kept, strengths, tuple(map(float, logistic(measured, WIDTH))))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, over whole texts.

    Words match the lexicon as they are or with the edits it allows. A hit within quotation
    marks, or near a word that reports speech, counts as quoted, any other as abuse; the
    weights of both are learned. A null text scores like an empty one; every row gives a row, and an empty
    table an empty one. Without usable labels no text is toxic.
    """
    model = learn(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(model.weights)
        for batch in batches:
            # Summed row by row: a score must not depend on the rows beside it.
            raw = (_measured(batch.column("text").to_pylist(), model) * weights).sum(axis=1)
            found = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    rated = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return rated.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
