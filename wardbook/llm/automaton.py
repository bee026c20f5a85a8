"""Several byte patterns as one minimal deterministic automaton of numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

# A pattern is a tuple: ("set", bytes), ("seq", parts), ("alt", parts), ("star", part).
Pattern = tuple


def one_of(chars: str) -> Pattern:
    """One byte out of ASCII ``chars``; ``a-z`` style ranges are written out by ``span``."""
    return ("set", frozenset(chars.encode("ascii")))


def span(*ranges: str, more: str = "") -> Pattern:
    """One byte within two-letter ranges such as ``AZ``, or out of ``more``."""
    found = {b for r in ranges for b in range(ord(r[0]), ord(r[1]) + 1)}
    return ("set", frozenset(found | set(more.encode("ascii"))))


def text(word: str, any_case: bool = False) -> Pattern:
    """``word`` itself; with ``any_case`` ASCII letters match in either case."""
    return seq(*(one_of(c.lower() + c.upper() if any_case else c) for c in word))


def seq(*parts: Pattern) -> Pattern:
    return ("seq", parts)


def alt(*parts: Pattern) -> Pattern:
    return ("alt", parts)


def any_number(part: Pattern) -> Pattern:
    return ("star", part)


def some(part: Pattern) -> Pattern:
    return seq(part, any_number(part))


def maybe(part: Pattern) -> Pattern:
    return alt(part, seq())


def backwards(pattern: Pattern) -> Pattern:
    kind, body = pattern
    if kind == "seq":
        return ("seq", tuple(backwards(p) for p in reversed(body)))
    if kind == "alt":
        return ("alt", tuple(backwards(p) for p in body))
    return ("star", backwards(body)) if kind == "star" else pattern


#: No UTF-8 text has this byte; it parts texts and leads every state back to the start.
SEPARATOR = 0xFF


class _Graph:
    """States with empty moves and moves on byte sets."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, pattern: Pattern, start: int) -> int:
        """Lay ``pattern`` out from ``start``; the state behind it."""
        kind, body = pattern
        if kind == "seq":
            for part in body:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "set":
            self.moves[start].append((body, end))
        elif kind == "alt":
            for part in body:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
        else:
            hub = self.state()
            self.empty[start].append(hub)
            self.empty[self.add(body, hub)].append(hub)
            self.empty[hub].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for other in self.empty[todo.pop()]:
                if other not in found:
                    found.add(other)
                    todo.append(other)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``moves[state * classes + byte_class]`` is the next state times ``classes``.

    ``accepts[state]`` has bit k set where pattern k ends. State 0 is the start;
    ``dead`` is the state without a way on, or -1.
    """

    byte_class: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray
    classes: int
    dead: int


def compile_patterns(patterns: Iterable[Pattern], anchored: bool = False) -> Automaton:
    """Subset construction over all patterns at once, then minimisation.

    Unless ``anchored``, a match may begin at any byte.
    """
    graph = _Graph()
    start = graph.state()
    ends: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        first = graph.state()
        graph.empty[start].append(first)
        ends[graph.add(pattern, first)] = 1 << k
    # Bytes that no set tells apart share a class.
    sets = sorted({s for moves in graph.moves for s, _ in moves}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    numbered = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
    byte_class = np.array([numbered[s] for s in signature], dtype=np.uint8)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(numbered))]

    origin = graph.closed([start])
    # Where each state gets on each byte class, and what the empty moves add.
    onward = [
        [{c for s, to in moves if byte in s for c in graph.closed([to])} for byte in sample]
        for moves in graph.moves
    ]
    known, order, table = {origin: 0}, [origin], []
    for members in order:
        row = []
        moving = [onward[m] for m in members if graph.moves[m]]
        for c in range(len(sample)):
            target = frozenset().union(*(there[c] for there in moving))
            if not anchored:
                target |= origin
            if target not in known:
                known[target] = len(order)
                order.append(target)
            row.append(known[target])
        table.append(row)
    moves = np.array(table, dtype=np.int64)
    accepts = np.array([sum({ends.get(m, 0) for m in members}) for members in order])
    moves, accepts = _minimised(moves, accepts)
    classes = moves.shape[1]
    own = np.arange(len(moves))
    idle = np.flatnonzero((moves == own[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(
        byte_class,
        np.ascontiguousarray(moves * classes, dtype=np.int32).ravel(),
        accepts,
        classes,
        int(idle[0]) if anchored and len(idle) else -1,
    )


def _minimised(moves: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split blocks of states until all states of a block move to the same blocks."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        split = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1]
        split = split.ravel()
        if split.max() == block.max():
            break
        block = split
    # The start's block becomes state 0.
    place = np.argsort(np.argsort(block != block[0], kind="stable"), kind="stable")
    _, first = np.unique(block, return_index=True)
    ordered = first[np.argsort(place[first], kind="stable")]
    number = np.empty(len(first), dtype=np.int64)
    number[block[ordered]] = np.arange(len(ordered))
    return number[block[moves[ordered]]], accepts[ordered]


def trace(machine: Automaton, data: np.ndarray, lane: int = 2048) -> np.ndarray:
    """The state (times ``classes``) after each byte of ``data``, in one pass.

    The bytes are laid out in lanes that advance together, each from the start state. A
    lane whose true first state is another one is walked again until the states agree,
    which takes a few bytes as a rule.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int32)
    lane = min(lane, n)
    lanes = -(-n // lane)
    padded = np.full(lanes * lane, SEPARATOR, dtype=np.uint8)
    padded[:n] = data
    steps = np.ascontiguousarray(machine.byte_class[padded].reshape(lanes, lane).T)
    states = np.empty((lane, lanes), dtype=np.int32)
    at = np.zeros(lanes, dtype=np.int32)
    for j in range(lane):
        at = machine.moves.take(at + steps[j])
        states[j] = at
    found = np.ascontiguousarray(states.T).ravel()
    kinds, moves = machine.byte_class, machine.moves
    for k in range(1, lanes):
        true = int(found[k * lane - 1])
        if not true:
            continue
        for i in range(k * lane, min((k + 1) * lane, n)):
            true = int(moves[true + int(kinds[padded[i]])])
            if found[i] == true:
                break
            found[i] = true
    return found[:n]


def ends_of(machine: Automaton, states: np.ndarray, pattern: int, run: int = 1) -> np.ndarray:
    """Where runs of ``run`` or more bytes that end a match of ``pattern`` stop, exclusive."""
    edge = np.flatnonzero(((machine.accepts >> pattern) & 1).astype(bool).repeat(machine.classes)[states])
    if not len(edge):
        return edge
    gaps = np.flatnonzero(np.diff(edge) != 1)
    firsts, lasts = edge[np.append(0, gaps + 1)], edge[np.append(gaps, len(edge) - 1)]
    return lasts[lasts - firsts + 1 >= run] + 1


def starts_of(machine: Automaton, data: bytes, end: int, least: int) -> list[int]:
    """Where matches that end at ``end`` start, from ``least`` on, latest first.

    ``machine`` is the anchored automaton of the pattern backwards.
    """
    state, found = 0, []
    for i in range(end - 1, least - 1, -1):
        state = int(machine.moves[state + int(machine.byte_class[data[i]])])
        place = state // machine.classes
        if place == machine.dead:
            break
        if machine.accepts[place]:
            found.append(i)
    return found
