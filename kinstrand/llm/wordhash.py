"""Vectorised words, word hashes and rolling word-window hashes over Arrow text.

A *slice* is a run of documents whose UTF-8 bytes are looked at together; every
step is a numpy operation over the slice, so memory is a small multiple of the
slice's bytes and nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and \t \n \v \f \r.
WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True

#: Odd multipliers of the two independent rolling hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def powers(lane: int, size: int) -> np.ndarray:
    """B**0, B**1, ... modulo 2**64, at least ``size`` of them."""
    have = _POWERS.get(lane)
    if have is None or len(have) < size:
        n = 1 << max(16, int(size - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, MULTIPLIERS[lane], np.uint64)]), dtype=np.uint64)
        _POWERS[lane] = have
    return have


def inverse(lane: int) -> int:
    return pow(MULTIPLIERS[lane], -1, 1 << 64)


_INVERSES: dict[int, np.ndarray] = {}


def inverse_powers(lane: int, size: int) -> np.ndarray:
    have = _INVERSES.get(lane)
    if have is None or len(have) < size:
        n = 1 << max(16, int(size - 1).bit_length())
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse(lane), np.uint64)]), dtype=np.uint64)
        _INVERSES[lane] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Rolling hashes of values[start:end], independent of where they stand."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(lane, len(values))[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse_powers(lane, len(values) + 1)[starts])


@dataclass
class Slice:
    """Words of some documents: ``doc`` gives the row of each word."""

    first_row: int
    rows: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    word_at: np.ndarray  # of each row, the number of its first word; one more at the end

    def hashes(self, lane: int) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mix(ranges(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, lane) + lengths)

    def windows(self, hashes: np.ndarray, size: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers at which ``size`` words of one document start, and the hashes of those words."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, ranges(hashes, at, at + size, lane)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[Slice]:
    """Cuts a text column into runs of about ``limit`` bytes, whole documents each."""
    if not len(column):
        return
    offsets, data = text_bytes(column)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield _slice(row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]])
        row = end


def _slice(first_row: int, offsets: np.ndarray, data: np.ndarray) -> Slice:
    rows = len(offsets) - 1
    inside = ~_IS_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)  # where a document starts, an earlier word ends
    fresh[offsets] = True
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1] | fresh[1 : len(data)]
        end[:-1] &= ~inside[1:] | fresh[1 : len(data)]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    word_at = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(rows), np.diff(word_at))
    return Slice(first_row, rows, data, starts, ends, doc, word_at)
