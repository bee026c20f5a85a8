"""Pack documents into sequences of power-of-two length."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.shared import releasing

MAX_LENGTH = 2048
END_ID = 1
# Words kept per worker process; the most memory a worker needs beside its batch.
CACHE_WORDS = 1_000_000
# Longer ones seldom come again, and could be of any length where a text has no blanks.
CACHE_WORD_CHARS = 32
# New words looked at together: few enough to stay in a core's own memory.
GROUP_WORDS = 2_000
# Documents of one call of the tokenizer, by bytes: the longer, the oftener a word repeats.
CHUNK_BYTES = 4_000_000

# Fixed value: how the tokenizer parts words.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Below U+0130 no character changes under NFC and every letter has a one-letter lower case.
# The separators in between are white space to some libraries only.
_ODD_FROM = 0x130
_ODD = re.compile(f"[\x1c-\x1f\x85{chr(_ODD_FROM)}-\U0010ffff]")


class WordTokenizer:
    """Ids of texts by a lower-casing tokenizer that drops white space.

    It never joins characters across white space, so each different word between blanks is
    looked up once a call, and the texts are put together from the ids of their words. New
    words of plain characters are lower-cased and parted here, by the tokenizer's own rule;
    a part has the ids of the word that is just this part. Other words go through the
    tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = True
        # The same model for parts that are normal already, and how it writes their bytes.
        self._model = self._whole.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._written = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(_ODD_FROM)}
        self._ids: dict[str, bytes] = {}

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        tokenize, blank = self._model.tokenize, self._written[ord(" ")]
        # No part holds a blank.
        written = " ".join(parts).translate(self._written).split(blank) if parts else []
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in written]

    def _of_words(self, words: list[str]) -> list[bytes]:
        found = self._whole.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, words: list[str]) -> list[bytes]:
        known = self._ids
        plain: dict[str, list[str]] = {}
        odd = []
        for word in words:
            if _ODD.search(word):
                odd.append(word)
            else:
                low = word.lower()
                plain[word] = [low] if low.isalpha() else _PARTS.findall(low)
        parts = [p for p in set().union(*plain.values()) if p not in known]
        known.update(zip(parts, self._of_parts(parts), strict=True))
        known.update((w, b"".join([known[p] for p in own])) for w, own in plain.items())
        known.update(zip(odd, self._of_words(odd), strict=True))
        found = [known[w] for w in words]
        for word in (*parts, *words):
            if len(word) > CACHE_WORD_CHARS:
                known.pop(word, None)
        return found

    def _look_up(self, words: list[str]) -> list[bytes]:
        found = list(map(self._ids.get, words))
        places = [i for i, ids in enumerate(found) if ids is None]
        if len(self._ids) + len(places) > CACHE_WORDS:
            self._ids.clear()
        for at in range(0, len(places), GROUP_WORDS):
            group = places[at : at + GROUP_WORDS]
            for i, ids in zip(group, self._learn([words[i] for i in group]), strict=True):
                found[i] = ids
        return found

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Unsigned 32-bit ids of each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(), dtype="i8")
        words = split.flatten().dictionary_encode()
        known = self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        found = pa.array(known, pa.large_binary()).take(words.indices)
        own = pa.LargeListArray.from_arrays(np.append(0, ends), found)
        return pc.binary_join(own, pa.scalar(b"", pa.large_binary())).to_pylist()


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(n: int, max_length: int) -> list[int]:
    """Lengths of a document's pieces: whole ``max_length`` ones, then its binary digits."""
    whole, rest = divmod(n, max_length)
    bits = [1 << b for b in range(max_length.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [max_length] * whole + bits


def _chunks(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= CHUNK_BYTES:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def pack(
    docs: DataFrame,
    tokenizer: str,
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Sequences of one piece each: ``doc_id, start, length, ids, doc_tokens, bucket,
    sequence_id, offset``.

    Every document gets its ids and ``end_id``, and is cut into pieces of power-of-two
    length, largest first, none above ``max_length`` (itself a power of two). A piece is a sequence, so no
    sequence crosses documents and none is padded; ``bucket``, the length's exponent,
    brings sequences of one length together, as by ``partitionBy("bucket")``. ``ids``
    holds little-endian unsigned 32-bit numbers. ``tokenizer`` names a file present on
    every executor. One pass without a shuffle.

    A null or empty text is ``end_id`` alone. Repeated rows, also with one ``doc_id``, are
    packed each; a null ``doc_id`` is kept. An empty table gives an empty one.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            keys = batch.column("doc_id").to_pylist()
            kind = batch.schema.field("doc_id").type
            for chunk in _chunks(pc.binary_length(texts).to_pylist()):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for key, found in zip(keys[chunk], words.ids(texts[chunk]), strict=True):
                    ids, start = found + end, 0
                    for length in pieces(len(ids) // 4, max_length):
                        piece = ids[4 * start : 4 * (start + length)]
                        row = (key, start, length, piece, len(ids) // 4, length.bit_length() - 1)
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                        start += length
                types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
                names = ("doc_id", "start", "length", "ids", "doc_tokens", "bucket")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=list(names)
                )

    schema = (
        f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, bucket int"
    )
    packed = docs.select("doc_id", "text").mapInArrow(releasing(run), schema)
    return packed.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
