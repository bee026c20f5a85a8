"""Remove long byte strings that earlier documents hold, by suffix arrays."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.shared import staged
from wardbook.operators.keyed import left_join_unique

LENGTH = 50
#: Bytes of the gram by which strings meet.
GRAM = 20
#: Text bytes of a block of documents, and of a pass over one; longer texts have blocks of their own.
BLOCK = 1_000_000
PASS = 2_000_000
#: Packed bytes that one task should get of what meets, and bytes of one suffix array.
SHARD = 2_000_000
ARRAY = 4_000_000
#: Strings around one anchor, counted by block, that may meet in one task.
HOT = 50_000
#: Strings that a block sends at a time, but whole shards.
PORTION = 50_000
_MASK = np.uint64((1 << 24) - 1)
_KEY_BITS = 39
_FLAG = 1 << _KEY_BITS


def _mixed(data: np.ndarray, n: int, places: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each of the first ``n`` places, or from some."""

    def load(at: int) -> np.ndarray:
        words = np.ndarray((n,), "<u8", data, at, (1,))
        return words.copy() if places is None else words[places]

    found = load(0) * np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(29)
    found += load(8)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    found += load(GRAM - 8)
    found *= np.uint64(0x94D049BB133111EB)
    found ^= found >> np.uint64(31)
    return found


@dataclass
class Runs:
    """Stretches of windows that agree on their anchor.

    A window is a string of ``LENGTH`` bytes; its anchor is the gram in it of the least hash, the
    first of equals, so equal windows have equal anchors at equal places. ``count``
    windows from ``start`` on have the anchor ``offset`` bytes behind ``start``.
    """

    start: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def runs_of(data: bytes, ends: np.ndarray) -> Runs:
    """The runs of texts laid end to end; ``ends`` are where the texts end."""
    padded = np.frombuffer(data + bytes(32), dtype=np.uint8)
    begins = np.append(0, ends[:-1])
    valid = np.zeros(len(data) + 1, dtype=np.int8)
    long = ends - begins >= LENGTH
    valid[begins[long]] += 1
    np.subtract.at(valid, ends[long] - LENGTH + 1, 1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    parts = []
    grams = LENGTH - GRAM + 1
    for at in range(0, len(data), PASS):
        windows = np.flatnonzero(valid[at : at + PASS])
        if not len(windows):
            continue
        n = min(PASS + grams, len(data) - at)
        hashed = _mixed(padded[at:], n)
        least = (hashed & ~_MASK) | np.arange(n, dtype=np.uint64)
        reach = 1
        while reach < grams:
            step = min(reach, grams - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        place = (least[windows] & _MASK).astype(np.int64)
        new = np.append(True, (np.diff(place) != 0) | (np.diff(windows) != 1))
        # A text's first window starts a run even where the text before ran up to it.
        new |= np.isin(windows + at, begins)
        first = np.flatnonzero(new)
        start = windows[first]
        parts.append(
            (start + at, np.diff(np.append(first, len(windows))), place[first] - start, hashed[place[first]])
        )
    if not parts:
        empty = np.empty(0, dtype=np.int64)
        return Runs(empty, empty, empty, empty.astype(np.uint64), empty)
    start, count, offset, hashes = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Runs(start, count, offset, hashes, np.searchsorted(ends, start, side="right"))


def _sketch(data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of strings of ``LENGTH`` to 80 bytes, by grams that cover them."""
    padded = np.frombuffer(data + bytes(32), dtype=np.uint8)
    found = length.astype(np.uint64)
    for k in range(4):
        found ^= _mixed(padded, len(data), start + np.minimum(k * GRAM, length - GRAM))
        found *= np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(31)
    return found


def _single_windows(data: bytes, runs: Runs, picked: np.ndarray) -> Runs:
    """The windows of some runs, each a run of its own that meets others by all its bytes."""
    count = runs.count[picked]
    before = np.cumsum(count) - count
    start = np.repeat(runs.start[picked] - before, count) + np.arange(count.sum())
    one = np.ones_like(start)
    return Runs(start, one, one - 1, _sketch(data, start, one * LENGTH), np.repeat(runs.doc[picked], count))


def _meeting(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard and key of a hash in one number: low bits choose the shard, high ones the key."""
    shard = ((hashes & _MASK) * np.uint64(shards)) >> np.uint64(24)
    return (shard << np.uint64(_KEY_BITS + 1)) | (hashes >> np.uint64(64 - _KEY_BITS))


def _pack(numbers: np.ndarray) -> bytes:
    """The low 40 bits of each number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def suffix_array(data: bytes, places: np.ndarray, depth: int | None = None) -> np.ndarray:
    """``places`` sorted by the suffixes of ``data`` that start there, or by their first ``depth`` bytes.

    Larsson and Sadakane's refinement: all suffixes get the rank of their first eight bytes;
    then groups of equal rank, and these alone, are sorted by the rank of what follows,
    so that the depth that ranks tell apart doubles each round. With a ``depth``, of eight or more,
    the last round ends there, and each round ranks only the suffixes that later ones ask for;
    places that agree so far stand in any order.
    """
    n = len(data)
    wanted = np.zeros(n, dtype=bool)
    wanted[places] = True
    needed, rounds = _rounds(wanted, depth)
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    order = np.flatnonzero(needed)
    head = np.ndarray((n,), ">u8", padded, 0, (1,))[order].astype(np.uint64)
    first = np.argsort(head)
    order, head = order[first], head[first]
    slots = np.arange(len(order))
    ranks = np.zeros(n, dtype=np.int64)
    # A group's rank is the place of its last member, as sorted groups keep theirs.
    last = np.append(head[1:] != head[:-1], True)[: len(head)]
    ranks[order] = np.flatnonzero(last)[np.cumsum(last) - last]
    for step, later in rounds:
        kept = later[order]
        order, slots = order[kept], slots[kept]
        group = ranks[order]
        new = group[1:] != group[:-1]
        open_places = np.flatnonzero(~(np.append(True, new) & np.append(new, True)))
        if not len(open_places):
            break
        members, own = order[open_places], group[open_places]
        behind = members + step
        # Suffixes that end before that are prefixes of the others; the shorter stands first.
        after = np.where(behind < n, ranks[np.minimum(behind, n - 1)], n - 1 - behind)
        both = own * (4 * n) + after
        again = np.argsort(both)
        members, both = members[again], both[again]
        order[open_places] = members
        edge = np.append(both[1:] != both[:-1], True)
        ranks[members] = slots[open_places[edge]][np.cumsum(edge) - edge]
    return order[wanted[order]]


def _rounds(wanted: np.ndarray, depth: int | None) -> tuple[np.ndarray, Iterable[tuple[int, np.ndarray]]]:
    """The suffixes to rank by eight bytes; then how far behind each round looks, and which it ranks."""
    if depth is None:
        every = np.ones_like(wanted)
        return every, ((8 << k, every) for k in itertools.count())
    steps, reach = [], 8
    while reach < depth:
        steps.append(min(reach, depth - reach))
        reach += steps[-1]
    needed = [wanted]
    for step in reversed(steps):
        earlier = needed[0].copy()
        earlier[step:] |= needed[0][:-step]
        needed.insert(0, earlier)
    return needed[0], zip(steps, needed[1:], strict=True)


def common_prefixes(
    data: bytes, order: np.ndarray, strings: tuple[np.ndarray, np.ndarray], most: int
) -> np.ndarray:
    """Bytes each suffix of ``order`` shares with the one before, up to ``most``.

    Kasai's rule, that a suffix shares at most one byte less than the suffix one place
    earlier, is walked for all strings at once: ``strings`` holds their first suffixes and
    how many suffixes follow each other from there. ``order`` need only tell ``most`` bytes apart.
    """
    text = np.frombuffer(data + bytes(most), dtype=np.uint8)
    before = np.full(len(data) + 1, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    placed = np.full(len(data) + 2, len(data))
    placed[order] = np.arange(len(order))
    shared = np.zeros(len(data) + 1, dtype=np.int64)
    first, count = strings
    length = np.zeros(len(first), dtype=np.int64)
    last = np.full(len(first), -1, dtype=np.int64)
    for step in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > step)
        own = first[live] + step
        other = before[own]
        # The rule holds where the earlier suffix's neighbour has a next one before this in the order.
        holds = (other >= 0) & (last[live] >= 0) & (placed[last[live] + 1] < placed[own])
        length[live] = np.where(holds, np.maximum(length[live] - 1, 0), 0)
        last[live] = other
        growing = live[other >= 0]
        while len(growing):
            mine = first[growing] + step + length[growing]
            theirs = before[first[growing] + step] + length[growing]
            same = (length[growing] < most) & (text[mine] == text[theirs])
            growing = growing[same]
            length[growing] += 1
        shared[own] = length[live]
    return shared[order]


@dataclass
class _Array:
    """The windows of one suffix array: their places, in order, and which are the first of equals.

    ``least`` has the smallest document of each different window.
    """

    data: bytes
    order: np.ndarray
    fresh: np.ndarray
    least: np.ndarray

    def windows(self) -> np.ndarray:
        return _windows_at(self.data, self.order[self.fresh])


def _sorted_windows(data: bytes, first: np.ndarray, count: np.ndarray, docs: np.ndarray) -> _Array:
    """The windows of strings that start at ``first``, by suffix array and common prefixes."""
    places = _following(first, count)
    owner = np.zeros(len(data), dtype=np.int64)
    owner[places] = np.repeat(docs, count)
    order = suffix_array(data, places, LENGTH)
    fresh = common_prefixes(data, order, (first, count), LENGTH) < LENGTH
    fresh[:1] = True
    return _Array(data, order, fresh, np.minimum.reduceat(owner[order], np.flatnonzero(fresh)))


def _following(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each ``first`` on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _windows_at(data: bytes, places: np.ndarray) -> np.ndarray:
    text = np.frombuffer(data, dtype=np.uint8)
    wide = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[places] if len(places) else text[:0]
    return np.ascontiguousarray(wide).view(f"S{LENGTH}").ravel()


def earliest(strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each string, the smallest document that has each of its windows.

    The strings are cut into shards of ``ARRAY`` bytes with a suffix array each; what
    shards have in common is found by binary search in one another's sorted windows.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    shard_of = (np.cumsum(sizes) - sizes) // ARRAY
    arrays, laid = [], []
    for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(shard_of)) + 1) if strings else []:
        data = b"".join([strings[i] for i in own.tolist()])
        first, count = np.cumsum(sizes[own]) - sizes[own], sizes[own] - LENGTH + 1
        arrays.append(_sorted_windows(data, first, count, docs[own]))
        laid.append(_following(first, count))
    merged = [array.least.copy() for array in arrays]
    for mine, theirs in itertools.combinations(range(len(arrays)), 2):
        asked, known = arrays[mine].windows(), arrays[theirs].windows()
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        same = np.flatnonzero(known[at] == asked)
        both = np.minimum(arrays[mine].least[same], arrays[theirs].least[at[same]])
        merged[mine][same] = np.minimum(merged[mine][same], both)
        merged[theirs][at[same]] = np.minimum(merged[theirs][at[same]], both)
    found: list[np.ndarray] = []
    for array, least, places in zip(arrays, merged, laid, strict=True):
        by_place = np.empty(len(array.data), dtype=np.int64)
        by_place[array.order] = least[np.cumsum(array.fresh) - 1]
        found.append(by_place[places])
    flat = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    ends = np.cumsum(sizes - LENGTH + 1).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _blocks(docs: DataFrame) -> DataFrame:
    """``block, ids, sizes, n_bytes, texts``: documents laid together, texts compressed.

    The number of a block is part of the written table, so later steps may be repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)

        def packed(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            joined = b"".join(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([len(joined)], pa.int64()),
                    pa.array([squeeze.compress(joined)], pa.binary()),
                ],
                names=["ids", "sizes", "n_bytes", "texts"],
            )

        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for key, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                data = (text or "").encode("utf-8", "surrogatepass")
                if texts and size + len(data) > BLOCK:
                    yield packed(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(key)
                texts.append(data)
                size += len(data)
        if texts:
            yield packed(ids, texts)

    schema = "ids array<long>, sizes array<long>, n_bytes long, texts binary"
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return laid.select(F.monotonically_increasing_id().alias("block"), "*")


_RANKLESS = np.iinfo(np.int64).max


def _opened(row: dict) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts, ends and ids of a block; a null id stands after all others."""
    ids = np.array([_RANKLESS if i is None else i for i in row["ids"]], dtype=np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=row["n_bytes"] + 1)
    return data, np.cumsum(np.array(row["sizes"], dtype=np.int64)), ids


def _among(keys: np.ndarray, told: list, hot: bool) -> np.ndarray:
    """Which of ``keys`` are among those that a block was told of, the hot ones or the others."""
    wanted = np.concatenate([_unpack(t["keys"]) | np.uint64(t["shard"] << (_KEY_BITS + 1)) for t in told])
    wanted = wanted[((wanted & np.uint64(_FLAG)) > 0) == hot] & ~np.uint64(_FLAG)
    if not len(wanted):
        return np.zeros(len(keys), dtype=bool)
    wanted.sort()
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _asked(row: dict, shards: int) -> tuple[bytes, np.ndarray, Runs]:
    """Texts, ids and runs of a block; of one with ``hot`` keys the single windows around those."""
    data, ends, ids = _opened(row)
    runs = runs_of(data, ends)
    if "hot" in row:
        hot = _among(_meeting(runs.hash, shards), row["hot"], True)
        runs = _single_windows(data, runs, np.flatnonzero(hot))
    return data, ids, runs


def _announced(shards: int, anchors: int):
    """Each block's keys, once each, packed by shard, and how many strings each has there.

    A flag marks the keys of several ids. ``anchors`` is the number of shards of the anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, ids, runs = _asked(row, anchors)
                owner = ids[runs.doc]
                named = np.flatnonzero(owner != _RANKLESS)
                keys, owner = _meeting(runs.hash[named], shards), owner[named]
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
                if not len(heads):
                    continue
                several = np.maximum.reduceat(owner, heads) != np.minimum.reduceat(owner, heads)
                strings = _strings(data, runs, named[order], heads)
                keys = keys[heads] | (several.astype(np.uint64) << np.uint64(_KEY_BITS))
                shard = (keys >> np.uint64(_KEY_BITS + 1)).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                parts = [_pack(p) for p in np.split(keys, cuts[1:])]
                counts = [c.tobytes() for c in np.split(strings, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[cuts].astype(np.int32)),
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array(parts, pa.binary()),
                        pa.array(counts, pa.binary()),
                    ],
                    names=["shard", "block", "keys", "strings"],
                )

    return run


_ANNOUNCED = "shard int, block long, keys binary, strings binary"


def _strings(data: bytes, runs: Runs, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """How many different strings each key has; ``order`` has the runs by key, from ``heads`` on."""
    sizes = np.diff(np.append(heads, len(order)))
    key = np.repeat(np.arange(len(heads)), sizes)
    met = np.flatnonzero(np.repeat(sizes > 1, sizes))
    found = (sizes == 1).astype(np.int64)
    if len(met):
        own, key = order[met], key[met]
        sketch = _sketch(data, runs.start[own], runs.count[own] + LENGTH - 1)
        ranked = np.lexsort([sketch, key])
        key, sketch = key[ranked], sketch[ranked]
        fresh = np.append(True, (key[1:] != key[:-1]) | (sketch[1:] != sketch[:-1]))
        found += np.bincount(key[fresh], minlength=len(heads))
    return np.minimum(found, np.iinfo(np.uint16).max).astype("<u2")


def _shared(hot: int):
    """Of one shard, the keys that another block or another document has too, by block.

    A flag marks those of more than ``hot`` strings, which ``n_hot`` counts.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack(k) for k in group["keys"]]
        source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        flat = np.concatenate(keys)
        strings = np.concatenate([np.frombuffer(s, dtype="<u2") for s in group["strings"]]).astype(np.int64)
        flag = (flat & np.uint64(_FLAG)) > 0
        flat = flat & np.uint64(_FLAG - 1)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        same = ranked[1:] == ranked[:-1]
        met = np.zeros(len(flat), dtype=bool)
        met[order] = np.append(same, False) | np.append(False, same)
        met |= flag
        heads = np.flatnonzero(np.append(True, ~same))
        many = np.zeros(len(flat), dtype=bool)
        many[order] = np.repeat(
            np.add.reduceat(strings[order], heads) > hot, np.diff(np.append(heads, len(flat)))
        )
        flat |= many.astype(np.uint64) << np.uint64(_KEY_BITS)
        chosen = np.split(flat[met], np.cumsum(np.bincount(source[met], minlength=len(keys)))[:-1])
        n_hot = np.bincount(source, np.where(met & many, strings, 0), minlength=len(keys)).astype(np.int64)
        rows = [
            (shard, block, _pack(own), n)
            for shard, block, own, n in zip(
                group["shard"], group["block"], chosen, n_hot.tolist(), strict=True
            )
            if len(own)
        ]
        return pd.DataFrame(rows, columns=["shard", "block", "keys", "n_hot"]).astype(
            {"shard": "int32", "block": "int64", "n_hot": "int64"}
        )

    return run


def _sent(shards: int, anchors: int):
    """The strings around shared keys that are not hot, by shard, equal strings of a block once.

    Of equal strings the smallest document's is asked about; those of other documents in the
    block are ``settled``: an earlier document has all their windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                data, ids, runs = _asked(row, anchors)
                keys = _meeting(runs.hash, shards)
                hit = np.flatnonzero(_among(keys, row["shared"], False) & (ids[runs.doc] != _RANKLESS))
                # Smaller documents first, so the first of equal strings is the one to ask about.
                shard = (keys[hit] >> np.uint64(_KEY_BITS + 1)).astype(np.int64)
                order = np.lexsort([ids[runs.doc[hit]], shard])
                hit, shard = hit[order], shard[order]
                cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[: len(hit)]
                # Whole shards of a long text, some at a time.
                some = np.flatnonzero(np.diff(cuts // PORTION)) + 1
                for own in np.split(np.arange(len(hit)), cuts[some]) if len(hit) else []:
                    yield _letter(row["block"], data, ids, runs, hit[own], shard[own], squeeze)

    return run


def _letter(
    block: int,
    data: bytes,
    ids: np.ndarray,
    runs: Runs,
    hit: np.ndarray,
    shard: np.ndarray,
    squeeze: zstandard.ZstdCompressor,
) -> pa.RecordBatch:
    """What a block sends of some runs, a row per shard; runs are in order of shard and document."""
    start, count, doc = runs.start[hit], runs.count[hit], ids[runs.doc[hit]]
    numbers: dict[bytes, int] = {}
    number = np.array(
        [
            numbers.setdefault(data[a:b], len(numbers))
            for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)
        ]
    )
    first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
    asked = doc == doc[first][number]
    mine, others = np.flatnonzero(asked), np.flatnonzero(~asked)
    mine = mine[np.argsort(number[mine], kind="stable")]
    shards = shard[np.append(True, shard[1:] != shard[:-1])]

    def parted(values: np.ndarray, of: np.ndarray, kind: type) -> pa.Array:
        """The values of each shard; ``of`` are their runs."""
        packed = values.astype(kind)
        edges = [*np.searchsorted(shard[of], shards).tolist(), len(of)]
        return pa.array([packed[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())

    distinct = list(numbers)
    edges = [*np.searchsorted(shard[first], shards).tolist(), len(first)]
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array(shards.astype(np.int32)),
            "block": pa.array([block] * len(shards), pa.int64()),
            "strings": pa.array(
                [squeeze.compress(b"".join(distinct[a:b])) for a, b in zip(edges, edges[1:], strict=False)],
                pa.binary(),
            ),
            "sizes": parted(count[first] + LENGTH - 1, first, np.uint8),
            "offsets": parted(runs.offset[hit][first], first, np.uint8),
            "docs": parted(doc[first], first, np.int64),
            "times": parted(np.bincount(number[mine], minlength=len(first)), first, np.uint32),
            "starts": parted(start[mine], mine, np.int64),
            "settled": parted(start[others], others, np.int64),
            "counts": parted(count[others], others, np.uint8),
        }
    )


_SENT = (
    "shard int, block long, strings binary, sizes binary, offsets binary, docs binary, "
    "times binary, starts binary, settled binary, counts binary"
)


def _judged(group: pd.DataFrame) -> pd.DataFrame:
    """Of one shard, the first windows and numbers of windows to remove, by block."""
    rows = group.to_dict("records")
    opened = zstandard.ZstdDecompressor()
    strings: list[bytes] = []
    for row in rows:
        ends = np.cumsum(np.frombuffer(row["sizes"], dtype=np.uint8), dtype=np.int64).tolist()
        data = opened.decompress(row["strings"], max_output_size=ends[-1] + 1)
        strings += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    length = _joined(rows, "sizes", np.uint8) - LENGTH + 1
    doc, times = _joined(rows, "docs", np.int64), _joined(rows, "times", np.uint32)
    starts = _joined(rows, "starts", np.int64)
    source = np.repeat(np.arange(len(rows)), [len(row["sizes"]) for row in rows])
    # Equal strings are settled by their numbers alone.
    numbers: dict[bytes, int] = {}
    number = np.array([numbers.setdefault(s, len(numbers)) for s in strings])
    least = np.full(len(numbers), _RANKLESS)
    np.minimum.at(least, number, doc)
    # Only strings that meet others at their anchor can share single windows with them.
    offset = np.empty(len(numbers), dtype=np.int64)
    offset[number] = _joined(rows, "offsets", np.uint8)
    grams: dict[bytes, int] = {}
    distinct = list(numbers)
    gram = np.array(
        [grams.setdefault(s[o : o + GRAM], len(grams)) for s, o in zip(distinct, offset.tolist(), strict=True)]
    )
    several = np.bincount(gram)[gram] > 1
    met = np.flatnonzero(several)
    found = earliest([distinct[i] for i in met.tolist()], least[met])
    # Runs of windows to remove: of which string, from which window on, how many.
    later = least[number] < doc
    whole = np.flatnonzero(later)
    part = np.flatnonzero(~later & several[number])
    place = np.cumsum(several) - 1
    # A window that stays parts each string from the next.
    ends = np.cumsum(length[part] + 1)
    gone = np.zeros(ends[-1] if len(ends) else 0, dtype=np.int8)
    if len(part):
        of_string = np.cumsum([len(f) for f in found])[place[number[part]]] - length[part]
        gone[_following(ends - length[part] - 1, length[part])] = np.concatenate(found)[
            _following(of_string, length[part])
        ] < np.repeat(doc[part], length[part])
    edges = np.diff(gone, prepend=np.int8(0))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    inside = np.searchsorted(ends, begin, side="right")
    run_of = np.concatenate([whole, part[inside]])
    run_at = np.concatenate([np.zeros_like(whole), begin - (ends - length[part] - 1)[inside]])
    run_count = np.concatenate([length[whole], end - begin])
    # Each stands wherever its block has the string.
    copies = times[run_of]
    at = starts[_following((np.cumsum(times) - times)[run_of], copies)] + np.repeat(run_at, copies)
    removed = np.column_stack([at, np.repeat(run_count, copies)])
    holder = np.repeat(source[run_of], copies)
    order = np.argsort(holder, kind="stable")
    removed, cuts = removed[order], np.searchsorted(holder[order], np.arange(1, len(rows)))
    result = []
    for row, own in zip(rows, np.split(removed, cuts), strict=True):
        settled = np.column_stack([_joined([row], "settled", np.int64), _joined([row], "counts", np.uint8)])
        if len(own) + len(settled):
            result.append((row["block"], np.concatenate([own, settled]).astype("<i8").tobytes()))
    return pd.DataFrame(result, columns=["block", "gone"]).astype({"block": "int64"})


def _joined(rows: list[dict], column: str, kind: type) -> np.ndarray:
    """The numbers that blocks packed into a column, of all rows."""
    return np.frombuffer(b"".join([row[column] for row in rows]), dtype=kind).astype(np.int64)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document without the bytes that its block's removed windows cover."""
    for batch in batches:
        for row in batch.to_pylist():
            data, ends, _ = _opened(row)
            change = np.zeros(len(data) + 1, dtype=np.int32)
            for part in row["gone"] or []:
                first, count = np.frombuffer(part, dtype="<i8").reshape(-1, 2).T
                np.add.at(change, first, 1)
                np.subtract.at(change, first + count + LENGTH - 1, 1)
            gone = np.cumsum(change[:-1]) > 0
            text = np.frombuffer(data, dtype=np.uint8)
            removed, spans, kept, at = [], [], [], 0
            for end in ends.tolist():
                own = gone[at:end]
                removed.append(int(own.sum()))
                spans.append(int((own & ~np.append(False, own[:-1])).sum()) if removed[-1] else 0)
                kept.append(text[at:end][~own].tobytes() if removed[-1] else data[at:end])
                at = end
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(row["sizes"], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of each document.

    Removed is each byte covered by a string of ``LENGTH`` bytes that also starts in a
    document with a smaller ``doc_id``, judged on the input. ``kept`` holds the other bytes;
    it may cut a character in two.

    Documents are laid in blocks. Strings can only be equal if they agree on their anchor
    (see ``Runs``), so blocks first exchange packed anchor keys and learn which of theirs
    others have, and then send the strings around those to the shards of the anchors.
    There, strings that meet different ones go into suffix arrays, whose common prefixes
    give the smallest document of every window. A block sends equal strings once.

    At the edges of a passage that many documents share, each of them has a string of its
    own around the same anchor, and so it is around any frequent gram. Blocks therefore tell
    how many strings a key has; where these are more than ``HOT``, the windows in them are
    exchanged in the same way a second time, each by a key of all its bytes. Then only
    equal windows meet, one of each block.

    A null text is empty. Rows with one ``doc_id`` do not shorten each other; a document
    with a null ``doc_id`` has no place in the order, stays whole and shortens none. An
    empty table gives an empty one.
    """
    blocks = staged(_blocks(docs), "blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    # A key of five bytes for every sixteen or so of text.
    shards = max(1, total * 5 // 16 // SHARD)
    wanted = _wanted(blocks, shards, shards, HOT)
    # Shared keys stand for about 80 bytes of text each.
    asking = left_join_unique(wanted, blocks, ["block"])
    judged = _removed(asking, shards, shards)
    n_hot = wanted.agg(F.sum("n_hot")).first()[0] or 0
    if n_hot:
        hot = wanted.where("n_hot > 0").select("block", F.col("shared").alias("hot"))
        hot = left_join_unique(hot, blocks, ["block"])
        # A key of five bytes for every window of a string.
        finer = max(1, n_hot * (LENGTH - GRAM + 1) * 5 // SHARD)
        met = _wanted(hot, finer, shards, _RANKLESS).drop("n_hot")
        asking = left_join_unique(met, hot, ["block"])
        judged = judged.unionByName(_removed(asking, finer, shards))
    gone = staged(judged.groupBy("block").agg(F.collect_list("gone").alias("gone")), "gone")
    return left_join_unique(blocks, gone, ["block"]).mapInArrow(
        _cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def _wanted(blocks: DataFrame, shards: int, anchors: int, hot: int) -> DataFrame:
    """``block, shared, n_hot``: by block, the keys that others have too."""
    announced = blocks.mapInArrow(_announced(shards, anchors), _ANNOUNCED)
    shared = announced.groupBy("shard").applyInPandas(
        _shared(hot), "shard int, block long, keys binary, n_hot long"
    )
    told = F.collect_list(F.struct("shard", "keys")).alias("shared")
    return staged(shared.groupBy("block").agg(told, F.sum("n_hot").alias("n_hot")), "shared")


def _removed(asking: DataFrame, shards: int, anchors: int) -> DataFrame:
    """``block, gone``: the windows that smaller documents have, of blocks with ``shared`` keys."""
    sent = asking.mapInArrow(_sent(shards, anchors), _SENT)
    return sent.groupBy("shard").applyInPandas(_judged, "block long, gone binary")
