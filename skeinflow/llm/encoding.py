"""Problem 6: the ids of a public byte-level BPE tokenizer for every text, by a bounded-lookahead streaming transducer.

From the merge list alone ``sufficient_lookahead`` computes how many bytes after a token's end can still change that token. A piece of any
length is then encoded in windows: tokens that end that many bytes before the window's end are stable and are emitted, the rest is carried
over, so memory doesn't grow with the piece. A boundary of an encoding splits it into two encodings, so carrying over is exact.
``Utf8Decoder`` is the inverse: an incremental state machine from bytes to text.

Cases: null and empty texts give an empty list; the strings of special tokens are ordinary text; no special token is ever emitted.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabularies; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: The split rule that belongs to the vocabulary (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept in the cache of a worker, and the bytes of a piece that may be kept.
CACHE_PIECES, CACHE_BYTES = 1 << 17, 48


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: bytes that print stand for themselves, the others are numbered on from 256."""
    shown = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: Iterable[tuple[int, int, int]], length: list[int]) -> int:
    """Bytes after a token's end that decide whether it stays, over all tokens.

    ``look[t]`` is what must be known to the right of the end of t, at the stage of the merge list reached so far, to know that t is there.
    A merge of (a, b) asks for b and all that b asks for; b may also be taken by an a whose own presence reaches further.
    """
    look = [0] * len(length)
    for a, b, new in merges:
        look[a] = max(look[a], length[b] + look[b])
        look[b] = max(look[b], look[a] - length[b])
        look[new] = max(look[b], look[a] - length[b])
    return max(look, default=0)


class Transducer:
    """Encodes and decodes by one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], split: str = SPLIT, window: int | None = None):
        alphabet = byte_alphabet()
        self.bytes_of: dict[int, bytes] = {}
        for text, i in vocab.items():
            if all(c in alphabet for c in text):
                self.bytes_of[i] = bytes(alphabet[c] for c in text)
        self.start = {b: vocab[c] for c, b in alphabet.items()}
        self.length = [len(self.bytes_of.get(i, b"")) for i in range(max(vocab.values()) + 1)]
        triples = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {(a, b): (k, new) for k, (a, b, new) in enumerate(triples)}
        self.lookahead = sufficient_lookahead(triples, self.length)
        self.window = max(window or 0, 2 * (self.lookahead + max(self.length)))
        self.split = regex.compile(split)
        self.cache: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one bounded byte string: the merge of least rank first, ties from the left."""
        ids = [self.start[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank, after, before, live = self.rank, list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
        return [t for t, ok in zip(ids, live) if ok]

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of a piece that comes in parts of any length; at most a window and one part are held."""
        held = b""
        for part in data:
            held += part
            at = 0
            while len(held) - at > self.window:
                end, limit = at, at + self.window - self.lookahead
                for t in self.merge(held[at : at + self.window]):
                    if end + self.length[t] > limit:
                        break
                    end += self.length[t]
                    yield t
                at = end
            held = held[at:]
        yield from self.merge(held)

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the split rule."""
        ids = self.cache.get(text)
        if ids is None:
            data = text.encode()
            ids = self.merge(data) if len(data) <= self.window else list(self.stream([data]))
            if len(data) <= CACHE_BYTES:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        known, piece = self.cache.get, self.piece
        for m in self.split.finditer(text or ""):
            s = m.group()
            out += known(s) or piece(s)
        return out

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        known, piece = self.cache.get, self.piece
        return sum(len(known(s) or piece(s)) for m in self.split.finditer(text or "") for s in (m.group(),))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        machine = Utf8Decoder()
        return "".join(machine.feed(self.bytes_of[i]) for i in ids) + machine.close()


class Utf8Decoder:
    """Bytes to text in parts: the state is the bytes still needed and the value so far; a broken sequence gives U+FFFD."""

    def __init__(self) -> None:
        self.need = self.value = self.least = 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need and b & 0xC0 == 0x80:
                self.value, self.need = self.value << 6 | b & 0x3F, self.need - 1
                if not self.need:
                    ok = self.least <= self.value <= 0x10FFFF and not 0xD800 <= self.value <= 0xDFFF
                    out.append(chr(self.value) if ok else "�")
                continue
            if self.need:
                out.append("�")
                self.need = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xE0:
                self.need, self.value, self.least = 1, b & 0x1F, 0x80
            elif 0xE0 <= b < 0xF0:
                self.need, self.value, self.least = 2, b & 0x0F, 0x800
            elif 0xF0 <= b < 0xF5:
                self.need, self.value, self.least = 3, b & 0x07, 0x10000
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


@lru_cache(maxsize=4)
def load(folder: str = TOKENIZERS, name: str = TOKENIZER) -> Transducer:
    """The transducer of a vocabulary file, once per worker."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    return Transducer(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """``df`` with the ids of ``text`` in ``out``; row by row, without a shuffle."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(folder, name)
        for s in parts:
            yield pd.Series([t.encode(x) for x in s], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of ids of ``text`` in ``out``; null texts count 0."""

    @F.pandas_udf(T.LongType())
    def n(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(folder, name)
        for s in parts:
            yield pd.Series([t.count(x) for x in s], dtype="int64")

    return df.withColumn(out, n(F.col(text)))


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """``df`` with the text of ``ids`` in ``out``; null ids give an empty text."""

    @F.pandas_udf(T.StringType())
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(folder, name)
        for s in parts:
            yield pd.Series([t.decode(x if x is not None else ()) for x in s], dtype=object)

    return df.withColumn(out, text(F.col(ids)))
