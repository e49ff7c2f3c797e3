"""Words and n-grams of whole Arrow string columns with numpy, without a Python object per word.

A batch is cut into runs of rows of about ``limit`` bytes, so the memory a task needs is
bounded by that and by its longest text. Within a run, word boundaries come from one
byte-class lookup and hashes from prefix sums of a polynomial over 2**64: with
``S[i] = sum(T[b_j] * M**j for j < i)`` the hash of bytes ``s..e`` is ``(S[e] - S[s]) * M**-s``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 19
_M, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words [^\x20\x09-\x0D]+.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(9, 14)]] = False
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_M))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, grown and kept per process."""
    had = _POWERS.get(base)
    if had is None or len(had) <= n:
        size = max(n + 1, 1 << 16)
        had = np.full(size, base, np.uint64)
        had[0] = 1
        had = np.multiply.accumulate(had)
        _POWERS[base] = had
    return had[: n + 1]


def ranged(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i and the inverse powers that shift a range back."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[:-1], out=sums[1:])
    return sums, powers(pow(base, -1, 1 << 64), len(values))


@dataclass
class Words:
    """Words of a run of texts: byte ranges, and for text i words first[i] .. first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return self._hash(self.end)

    def prefix_hashes(self, n: int) -> np.ndarray:
        return self._hash(np.minimum(self.start + n, self.end))

    def _hash(self, end: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_sums"):
            self._sums, self._back = ranged(_BYTE[self.data], _M)
        h = (self._sums[end] - self._sums[self.start]) * self._back[self.start]
        return mix(h + (end - self.start).astype(np.uint64))


def split_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]  # where a text ends and the next begins, a word does too
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[inside[cut] & inside[cut + 1]]
    begins[both] = ends[both] = True
    start, end = np.flatnonzero(begins[:n]), np.flatnonzero(ends)
    return Words(data, start, end, np.searchsorted(start, offsets))


def gram_hashes(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of words i .. i + k, for each i with k words left in the run (texts' ends ignored)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    sums, back = ranged(words, base)
    return mix((sums[k:] - sums[:-k]) * back[: len(words) - k + 1] + U(k))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which a k-gram begins that ends in the same text."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    base = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(len(base))


def covered(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the ranges starts .. starts + width."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def runs(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in runs of about ``limit`` bytes of text (a longer text is a run alone): rows, offsets, bytes."""
    for batch in batches:
        offsets, data = bytes_of(batch.column(batch.schema.names.index(text)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row), offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
            row = end


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts that lie one after another in ``data``, as an Arrow column without copying each."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))
    ).cast(pa.string())
