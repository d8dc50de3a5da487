"""Vectorised words, hashes and n-grams over the UTF-8 bytes of many texts at once.

Everything here works on whole texts. A batch is cut into runs of documents only to bound the
temporary arrays; a single long document is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15


def byte_class(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte after lower-casing A-Z) for the 256 byte values.

    ``alnum``: ASCII letters, digits and every non-ASCII byte. ``space``: all but the ASCII
    white space 0x20 and 0x09-0x0D.
    """
    byte = np.arange(256)
    low = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    if kind == "alnum":
        word = (byte >= 128) | ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122))
    elif kind == "space":
        word = ~((byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D)))
    else:
        raise ValueError(kind)
    return word, low


@lru_cache(maxsize=4)
def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9DDFEA08EB382D69, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def runs(column: pa.Array, most_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents: (first, past the last, their bytes, offsets from 0). Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a run of documents.

    start, end: byte positions; doc: each word's document; hash: of the lower-cased bytes, or with
    ``lower=False`` of the bytes as they are; first[d] is the number of words before document d.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: str, seed: int = 7, lower: bool = True):
        is_word, low_of = byte_class(kind)
        self.n_docs = len(offs) - 1
        self.low = low_of[data] if lower else data
        word = is_word[data]
        head = np.zeros(len(data) + 1, dtype=bool)
        head[offs[:-1]] = True
        head = head[:-1] if len(data) else head[:0]
        begins = word.copy()
        begins[1:] &= ~word[:-1] | head[1:]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | head[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offs)
        self.seed = seed

    @cached_property
    def hash(self) -> np.ndarray:
        return self._hash(self.seed)

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self, seed: int, most: int | None = None) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        keep = length if most is None else np.minimum(length, most)
        first = np.concatenate(([0], np.cumsum(keep)[:-1]))
        at = np.arange(int(keep.sum())) - np.repeat(first, keep)
        codes = _byte_codes(seed)[self.low[at + np.repeat(self.start, keep)]]
        total = np.add.reduceat(codes * _powers(int(keep.max()))[at], first)
        return mix(total ^ (keep.astype(np.uint64) * U(_MULTIPLIER)))

    def prefix_hash(self, n_bytes: int, seed: int = 7) -> np.ndarray:
        """Hash of each word's first bytes; equal to ``hash`` where the word is no longer."""
        return self._hash(seed, n_bytes)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every n consecutive words of one document."""
        m = len(self) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(m, np.uint64)
        for j, c in enumerate(_powers(n + 1)[1:]):
            total += self.hash[j : j + m] * c
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix(total[at] + U(n))
