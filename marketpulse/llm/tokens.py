"""Words of many texts at once: byte offsets and 64-bit hashes as NumPy arrays, no loop over words.

Texts arrive as Arrow arrays. They are handled in slices of half a MB, so that memory follows
the slice (or the longest single text) and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Byte classes: 0 separates words (0x20 and 0x09-0x0D); the rest of a word is 1.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0
#: As WORDS, but ASCII punctuation is a token class of its own.
WORDS_AND_MARKS = WORDS.copy()
WORDS_AND_MARKS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Tokens:
    """Tokens of `n` texts: text number, byte range in `data` and hash of every token."""

    n: int
    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each text's first token, and the number of tokens


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of runs of texts of about `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS, lower: bool = False) -> Tokens:
    """Maximal runs of bytes of one class other than 0 inside each text."""
    if lower:
        data = LOWER[data]
    n, size = len(offsets) - 1, len(data)
    kind = classes[data]
    change = np.ones(size + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:size])
    change[offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    wanted = kind[start] != 0
    start, end = start[wanted], end[wanted]
    powers, inverses = _powers(max(SLICE * 2, 1 << size.bit_length()))
    total = np.empty(size + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:size], out=total[1:])
    hashes = mixed((total[end] - total[start]) * inverses[start])
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    return Tokens(n, data, text, start, end, hashes, first)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-token sequences inside a text, and the index of each one's first token."""
    count = len(t.hash) - k + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = t.hash[:count].copy()
    for j in range(1, k):
        value = value * _BASE + t.hash[j : count + j]
    at = np.flatnonzero(t.text[:count] == t.text[k - 1 :])
    return mixed(value[at]), at


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: np.uint64) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return series(_BASE), series(_BASE_INVERSE)
