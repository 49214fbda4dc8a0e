"""Embedders: a Column of texts to a Column of vectors.

An embedder is any callable ``Column -> Column`` of ``array<float>``: an Arrow or
pandas UDF that calls a model fits as it is. The built-in one hashes tokens to signed
buckets, so that nothing but Spark is needed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, FloatType

# words as runs of letters, digits and underscores of any script
TOKEN = re.compile(r"\w+")
_GAP = re.compile(r"\W")
# a task forgets its token codes beyond this many
_CACHE = 1 << 17
# texts read together: at most so many, and so many characters (but for the last of them)
_GROUP_TEXTS, _GROUP_CHARS = 4096, 1 << 19
# fewer distinct tokens than this are digested one by one
_FEW = 200

# Fixed value: the dimension of the served vector column.
SERVED_DIM = 768


@dataclass(frozen=True)
class Model:
    """A vector column: which embedder fills it, and its dimension."""
    name: str
    column: str
    dim: int
    embed: Callable[[Column], Column]


def token_code(token: str, dim: int) -> tuple[int, int]:
    """Bucket and sign of a token, from its MD5."""
    digest = hashlib.md5(token.encode()).digest()
    return int.from_bytes(digest[:4], "big") % dim, 1 if digest[4] < 128 else -1


class _Codes(dict):
    """Twice the bucket of a token, and one more if its sign is negative; at most ``_CACHE`` of them."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        bucket, sign = token_code(token, self.dim)
        self[token] = code = 2 * bucket + (sign < 0)
        return code


def hash_texts(texts: Iterable[str | None], dim: int, codes: _Codes) -> np.ndarray:
    """Signed token counts per text, scaled to length 1; zeros for a text without tokens."""
    reader, parts, some, size = _Tokens(), [], [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= _GROUP_CHARS or len(some) >= _GROUP_TEXTS:
            parts.append(_counts(some, dim, codes, reader))
            some, size = [], 0
    parts.append(_counts(some, dim, codes, reader))
    counts = np.concatenate(parts).astype(float)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


def _counts(texts: list[str], dim: int, codes: _Codes, reader: _Tokens) -> np.ndarray:
    """Signed token counts of a few texts; a long one is read in pieces."""
    both = np.zeros(len(texts) * 2 * dim, np.int64)
    for piece, first in _pieces(texts):
        tokens, of = reader.read(piece)
        if len(tokens):
            found = tokens.dictionary_encode()
            code = _coded(found.dictionary, reader, dim, codes)[found.indices.to_numpy()]
            both[2 * dim * first:2 * dim * (first + len(piece))] += np.bincount(
                of * (2 * dim) + code, minlength=2 * dim * len(piece))
    both = both.reshape(len(texts), dim, 2)
    return both[:, :, 0] - both[:, :, 1]


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], int]]:
    """Texts of one group and the number of the first: all of them, or parts of a long text cut between words."""
    start = 0
    for i, text in enumerate(texts):
        if len(text) <= 2 * _GROUP_CHARS:
            continue
        if i > start:
            yield texts[start:i], start
        text, at = text.lower(), 0
        while at < len(text):
            cut = _GAP.search(text, at + _GROUP_CHARS)
            end = cut.end() if cut else len(text)
            yield [text[at:end]], i
            at = end
        start = i + 1
    if start < len(texts):
        yield texts[start:], start


class _Tokens:
    """Finds the lower-case tokens of many texts at once, as ``TOKEN`` does in ``text.lower()``."""

    def __init__(self):
        self.lower = np.zeros(0, np.uint32)
        self.word = np.zeros(0, bool)

    def _grow(self, most: int) -> None:
        """Tables of the lower case and of word characters, up to a code point."""
        have = len(self.lower)
        if most < have:
            return
        new = [chr(i) for i in range(have, min(max(256, 1 << most.bit_length()), 0x110000))]
        # those whose lower case is not one character don't come here
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in new]
        self.lower = np.concatenate([self.lower, np.array(low, np.uint32)])
        self.word = np.concatenate([self.word, np.array([c.isalnum() or c == "_" for c in new])])

    def read(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The tokens as arrays of code points (of one or four bytes, ``width``), and the text of each."""
        # the lower case of these two is longer, or depends on what stands around them
        texts = [t.lower() if "\u0130" in t or "\u03a3" in t else t for t in texts]
        joined = "\n".join(["", *texts, ""])
        try:
            points = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.width = points.itemsize
        self._grow(int(points.max()))
        word = self.word[points]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        kept = self.lower[points[word]].astype(points.dtype)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum((ends - starts) * self.width, out=offsets[1:])
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        first = np.cumsum([1] + [len(t) + 1 for t in texts])
        return tokens, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, first)))

    def texts(self, tokens: pa.Array) -> list[str]:
        """Tokens as Python strings."""
        kind = "latin-1" if self.width == 1 else "utf-32-le"
        return [t.decode(kind) for t in tokens.to_pylist()]


def _coded(tokens: pa.Array, reader: _Tokens, dim: int, codes: _Codes) -> np.ndarray:
    """The codes of distinct tokens: many are digested together, few or long ones one by one."""
    if len(tokens) < _FEW:
        return np.array([codes[t] for t in reader.texts(tokens)], np.int64)
    offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1] // reader.width
    points = np.frombuffer(tokens.buffers()[2], np.uint8 if reader.width == 1 else np.uint32)[offsets[0]:offsets[-1]]
    data = points.tobytes().decode("latin-1" if reader.width == 1 else "utf-32-le").encode()
    n_bytes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(n_bytes)])[offsets - offsets[0]]
    out = np.empty(len(tokens), np.int64)
    short = np.diff(ends) <= _MD5_BYTES
    first, negative = _md5_starts(np.frombuffer(data, np.uint8), ends[:-1][short], np.diff(ends)[short])
    out[short] = 2 * (first % dim) + negative
    long = np.flatnonzero(~short)
    out[long] = [codes[t] for t in reader.texts(tokens.take(pa.array(long)))]
    return out


# a token of at most this many bytes is one block of MD5
_MD5_BYTES = 55
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_START = (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)


def _md5_starts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the MD5 of many short byte strings: the first four bytes as a number, and whether the fifth is 128 or more."""
    n = len(starts)
    blocks = np.zeros((n, 64), np.uint8)
    rows = np.repeat(np.arange(n), sizes)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    blocks[rows, within] = data[np.repeat(starts, sizes) + within]
    blocks[np.arange(n), sizes] = 0x80
    words = np.ascontiguousarray(blocks.view("<u4").T)
    words[14] = sizes * 8
    used = words.any(axis=1)
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    for i in range(64):
        turn, j = divmod(i, 16)
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), j
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * j + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * j + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * j % 16
        f += a
        f += np.uint32(int(abs(math.sin(i + 1)) * 2**32))
        if used[g]:
            f += words[g]
        by = _MD5_TURNS[turn][i % 4]
        turned = f << np.uint32(by)
        f >>= np.uint32(32 - by)
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    a += np.uint32(_MD5_START[0])
    b += np.uint32(_MD5_START[1])
    return a.byteswap().astype(np.int64), ((b >> np.uint32(7)) & np.uint32(1)).astype(np.int64)


def hashing_model(dim: int = 64, column: str = "emb_hash") -> Model:
    @F.arrow_udf(ArrayType(FloatType()))
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = _Codes(dim)
        for texts in batches:
            # one text at a time becomes a Python string
            unit = hash_texts((t.as_py() for t in texts), dim, codes).astype(np.float32)
            offsets = pa.array(np.arange(len(unit) + 1) * dim, pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    # marked as such, an embedding is computed once and not again for every filter on it
    return Model(f"hash-{dim}", column, dim, hashed.asNondeterministic())
