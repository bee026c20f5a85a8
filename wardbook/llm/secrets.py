"""Find secrets by one automaton over all rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardbook.llm import automaton as au
from wardbook.llm.shared import numbered, releasing

#: Bytes scanned at once, the memory bound of a task beside its Arrow batch.
BLOCK = 2_000_000


def _always(_: bytes) -> bool:
    return True


@dataclass(frozen=True)
class Rule:
    """A pattern whose greedy, leftmost matches count where ``check`` holds.

    ``pattern`` must end in a run of one set or in a byte of its own, so that a match
    ends where the run does. Where the whole match is such a run, ``run`` may say how long
    it must be, which spares a look at shorter ones. What ``tail`` matches right behind a
    match belongs to it.
    """

    kind: str
    pattern: au.Pattern
    check: Callable[[bytes], bool] = _always
    run: int = 1
    tail: re.Pattern[bytes] | None = None


def _longer(n: int) -> Callable[[bytes], bool]:
    return lambda found: len(found) >= n


_VALUE = au.span("AZ", "az", "09", more="+/_.=-")


def _long_value(found: bytes) -> bool:
    """Whether what is assigned has 8 characters: what follows the sign, blanks and quote."""
    for i, byte in enumerate(found):
        if byte in b":=":
            value = found[i + 1 :].lstrip(b" ")
            return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 8
    return False


_QUOTE = au.maybe(au.one_of("\"'"))
_SPACES = au.any_number(au.one_of(" "))
_NAME = au.alt(
    *(au.text(w, any_case=True) for w in ("password", "passwd", "secret", "token")),
    au.seq(au.text("api", True), au.maybe(au.one_of("_")), au.text("key", True)),
)
_LETTERS = au.span("AZ", "az", "09", more="_-")
# A key's body: up to its END line, with any plain characters but no other marker between. Where
# that line is missing, its headers, long runs of base64 and short ones that fill their line or
# end the text; line breaks may be written out or lost.
_GAP = rb"""(?:[\s"',>#*|]|\\[nrt]?)"""
_KEY_BODY = re.compile(
    rb"""
    (?:(?!-----)[\t-\r\x20-\x7e])*+ -----END\x20[A-Z0-9\x20]*PRIVATE\x20KEY(?:\x20BLOCK)?+-----
    | (?:GAP*+ (?:(?:Proc-Type|DEK-Info):\x20?[A-Za-z0-9,-]++ | (?:Version|Comment|Charset):[^\n\r\\\xff]*+))*+
      (?:
        GAP*+ [A-Za-z0-9+/=]{16,}+
        | (?:(?!\n|\\n)GAP)*+ (?:\n|\\n) GAP*+ [A-Za-z0-9+/=]++ (?=[\t\x20]*+(?:[\r\n\\"'<\xff]|\Z))
      )*+
      (?:GAP*+ [A-Za-z0-9+/]++ (?:={1,2}|(?=\s*+(?:\xff|\Z))))?
    """.replace(b"GAP", _GAP),
    re.X,
)

# The first three are the base, in the order of their kinds.
RULES = (
    Rule(
        "assign",
        au.seq(_NAME, _QUOTE, _SPACES, au.one_of(":="), _SPACES, _QUOTE, au.some(_VALUE)),
        _long_value,
    ),
    Rule("access", au.seq(au.text("AKIA"), au.some(au.span("AZ", "09"))), _longer(16)),
    Rule("hex", au.some(au.span("09", "af")), _longer(32), run=32),
    Rule(
        "repository",
        au.seq(au.text("gh"), au.one_of("pousr"), au.text("_"), au.some(au.span("AZ", "az", "09"))),
        _longer(40),
    ),
    Rule("cloud", au.seq(au.text("AIza"), au.some(_LETTERS)), _longer(39)),
    Rule(
        "chat",
        au.seq(au.text("xox"), au.one_of("abprs"), au.text("-"), au.some(_LETTERS)),
        _longer(20),
    ),
    Rule(
        "private_key",
        au.seq(
            au.text("-----BEGIN "),
            au.any_number(au.span("AZ", more=" ")),
            au.text("PRIVATE KEY"),
            au.maybe(au.text(" BLOCK")),
            au.text("-----"),
        ),
        tail=_KEY_BODY,
    ),
    # One rule for two services: each run that may be open beside the others doubles the states.
    Rule(
        "service",
        au.seq(
            au.alt(
                au.text("github_pat_"),
                au.seq(au.one_of("sr"), au.text("k_"), au.alt(au.text("live"), au.text("test")), au.text("_")),
            ),
            au.some(au.span("AZ", "az", "09", more="_")),
        ),
        _longer(24),
    ),
)
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=4)
def _machines(rules: tuple[Rule, ...]) -> tuple[au.Automaton, list[au.Automaton]]:
    """One automaton for all rules, and one backwards for each."""
    whole = au.compile_patterns(r.pattern for r in rules)
    return whole, [au.compile_patterns([au.backwards(r.pattern)], anchored=True) for r in rules]


def find(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """``(kind, start, end)`` of each text's secrets in code points, by start, then kind."""
    whole, reverse = _machines(rules)
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = b"\xff".join(parts)
    data = np.frombuffer(joined, dtype=np.uint8)
    states = au.trace(whole, data)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        last_doc, free = -1, 0
        for end in map(int, au.ends_of(whole, states, k, rule.run)):
            doc = int(np.searchsorted(starts, end - 1, side="right")) - 1
            if doc != last_doc:
                last_doc, free = doc, int(starts[doc])
            found = au.starts_of(reverse[k], joined, end, free)
            if not found:
                continue
            if rule.tail:
                end = rule.tail.match(joined, end).end()
            free = end
            if rule.check(joined[found[-1] : end]):
                spans[doc].append((found[-1], k, end))
    out: list[list[tuple[str, int, int]]] = []
    for doc, own in enumerate(spans):
        first, rows, at, points = int(starts[doc]), [], 0, 0
        marks = sorted({p for s, _, e in own for p in (s, e)})
        place = {}
        for mark in marks:
            lead = data[first + at : mark] & 0xC0 != 0x80
            points += int(np.count_nonzero(lead))
            at, place[mark] = mark - first, points
        for s, k, e in sorted(own):
            rows.append((rules[k].kind, place[s], place[e]))
        out.append(rows)
    return out


def _blocks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, value in enumerate(texts):
        size += len(value)
        if size >= BLOCK:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _found(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    return [row for block in _blocks(texts) for row in find(texts[block], rules)]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: the secrets of each whole text, by start, then rule.

    Per rule the matches are those of a leftmost, greedy, non-overlapping search, less
    those that fail the rule's check; a failed match still hides what it covers. Starts and
    ends count code points, ends exclusive. One pass, no shuffle, no state between rows.

    A null or empty text has no spans. Every row gives a row, repeated ones too; a null
    ``doc_id`` is kept, other columns are not looked at; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        )
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [
                [{"kind": k, "start": s, "end": e} for k, s, e in own]
                for own in _found(texts, rules)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, spans_type)], names=["doc_id", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def redacted(value: str, spans: list[tuple[str, int, int]]) -> str:
    """``value`` with each span, overlapping ones as one, replaced by its kind in brackets."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [value[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, value[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, and ``n_chars`` counted anew.

    All other columns stay, and so does an ``n_chars`` that is neither a whole number nor text.
    A null text stays null.
    """

    def counted(kind: pa.DataType):
        if pa.types.is_integer(kind):
            return len
        return (lambda text: str(len(text))) if pa.types.is_string(kind) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = _found([t or "" for t in texts], rules)
            new = [t and redacted(t, s) for t, s in zip(texts, found, strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[text] = pa.array(new, batch.schema.field(text).type)
            size = n_chars in columns and counted(batch.schema.field(n_chars).type)
            if size:
                counts = [old if t is None else size(t) for t, old in
                          zip(new, columns[n_chars].to_pylist(), strict=True)]
                columns[n_chars] = pa.array(counts, batch.schema.field(n_chars).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    places = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    text, n_chars = places["text"], places.get("n_chars")
    plain = numbered(docs)
    return plain.mapInArrow(releasing(run), plain.schema).toDF(*docs.columns)
