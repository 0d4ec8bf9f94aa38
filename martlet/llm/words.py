"""Words of many texts at once, as numbers, straight from Arrow's buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. Those bytes never occur inside a UTF-8 character, so
bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from martlet.llm.common import mix

#: Bytes of text that are turned into numbers at once; one longer text is taken whole.
CHUNK_BYTES = 2 << 20

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _byte_codes(salt: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64), salt)


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64."""
    out = np.full(max(n, 1), base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


@dataclass
class Sums:
    """Polynomial prefix sums, from which the fingerprint of any stretch follows."""

    total: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, base: int = _BASE) -> Sums:
        n = len(codes)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(n, base), out=total[1:])
        return cls(total, powers(n + 1, pow(base, -1, 1 << 64)))

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.shift[start]


@dataclass
class Words:
    """Words of consecutive texts: ``first[d] .. first[d + 1]`` are those of text d."""

    code: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words_of(data: np.ndarray, at: np.ndarray, salt: int = 0) -> Words:
    """``data`` and ``at`` as from ``text_bytes``."""
    n = len(data)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < n)]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = Sums.of(_byte_codes(salt)[data])
    code = mix(sums.stretch(start, end), salt)
    return Words(code, np.searchsorted(start, at), start, end)


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with about ``most`` bytes of text each, and their bytes."""
    data, at = text_bytes(batch.column(column))
    i, rows = 0, len(at) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
