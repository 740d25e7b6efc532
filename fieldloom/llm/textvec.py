"""Vectorised word hashing over Arrow string buffers.

Texts of one slice lie back to back in one byte array. A word's hash is a polynomial
over its bytes modulo 2**64, taken from prefix sums, so a slice costs a handful of
NumPy passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
SLICE_ROWS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of white-space words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of alphanumeric words: every ASCII byte that is neither a letter nor a digit.
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = NON_ALNUM[128:] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, min(2 * len(_powers[0]), 1 << 21), 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def forget_powers() -> None:
    """Free the tables of powers; they are made again when needed."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buffer that holds the texts of an array, and where in it each begins and ends; null texts are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    return data, offsets


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows into the bytes) for runs of rows of about ``limit`` bytes, ``SLICE_ROWS`` rows at most."""
    n = batch.num_rows
    if n == 0:
        return
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + SLICE_ROWS, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of a slice: byte spans, the row each lies in, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: bool = True):
        """``fold``: A-Z count as a-z."""
        n = len(data)
        self.rows = len(offsets) - 1
        inside = ~separators[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets[1:], self.start, "right")
        #: words of row r are self.at[r] .. self.at[r + 1]
        self.at = np.searchsorted(self.row, np.arange(self.rows + 1))
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(((LOWER[data] if fold else data).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        self._sums, self._inverse = sums, inverse
        self.hash = self.prefix_hash(n + 1)

    def prefix_hash(self, length: int) -> np.ndarray:
        """Hashes of the words' first ``length`` bytes."""
        end = np.minimum(self.end, self.start + length)
        return mix((self._sums[end] - self._sums[self.start]) * self._inverse[self.start])

    def grams(self, k: int, step: np.uint64 = _STEP) -> tuple[np.ndarray, np.ndarray]:
        """Hash and index of the first word of each run of k words inside one row; another odd ``step`` gives another hash."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.array([k], np.uint64) * _BASE
        for j in range(k):
            total = total * step + self.hash[j : j + n]
        first = np.flatnonzero(self.row[k - 1 :] == self.row[:n])
        return mix(total[first]), first


def run_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of one whole word sequence, as ``grams`` gives it for that length."""
    total = np.array([len(hashes)], np.uint64) * _BASE
    for h in hashes:
        total = total * _STEP + h
    return mix(total)[0]


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct k-word shingle hashes; a row with 1..k-1 words has its whole sequence as one."""
    grams, first = words.grams(k)
    bounds = np.searchsorted(words.row[first] if len(first) else first, np.arange(words.rows + 1))
    out = []
    for r in range(words.rows):
        a, b = bounds[r], bounds[r + 1]
        if b > a:
            s = np.sort(grams[a:b])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if b - a > 1 else s)
        elif words.at[r + 1] > words.at[r]:
            out.append(np.array([run_hash(words.hash[words.at[r] : words.at[r + 1]])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ordered_shingles(words: Words, k: int = 5) -> list[np.ndarray]:
    """Per row its shingles in their order in the text; see ``shingle_sets``."""
    grams, first = words.grams(k)
    bounds = np.searchsorted(words.row[first] if len(first) else first, np.arange(words.rows + 1))
    out = []
    for r in range(words.rows):
        a, b = bounds[r], bounds[r + 1]
        own = words.hash[words.at[r] : words.at[r + 1]]
        out.append(grams[a:b] if b > a else np.array([run_hash(own)] if len(own) else [], np.uint64))
    return out
