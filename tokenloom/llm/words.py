"""Words of whole Arrow batches as numpy arrays: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
MASK = (1 << 64) - 1

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 & ~7 | 3
STEP = 0xC2B2AE3D27D4EB4F & ~7 | 3


def _table(is_word, fold: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for b in range(256):
        if fold and 65 <= b <= 90:
            out[b] = b + 32
        if not is_word(b):
            out[b] = 32
    return out


_SPACE = {0x20, *range(0x09, 0x0E)}
#: Words are runs of anything but blanks and the controls 09-0D, as they are or lower-cased A-Z.
PLAIN = _table(lambda b: b not in _SPACE, False)
FOLDED = _table(lambda b: b not in _SPACE, True)
#: Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased A-Z.
ALNUM = _table(lambda b: b > 0x7F or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64; grows as longer texts come."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * CHUNK), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def runs(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any run of values."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values ``start`` to ``end``, the same wherever the run stands."""
    back = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[end] - sums[start]) * back[start])


@dataclass
class Words:
    """The words of some rows, in order: row number, byte range and hash of each."""

    first: int          # number of the first row
    rows: int
    row: np.ndarray     # of each word, from 0 at the first row
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray    # the rows' bytes as given
    bounds: np.ndarray  # where rows begin in data, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def within(self, n: int) -> np.ndarray:
        """Whether ``n`` words from here stand in one row; as long as the words less n - 1."""
        if len(self.row) < n:
            return np.zeros(0, dtype=bool)
        return self.row[n - 1:] == self.row[:len(self.row) - n + 1]

    def grams(self, n: int) -> np.ndarray:
        """Hash of every ``n`` words in a run, also across rows (see ``within``)."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(m)
        return span(runs(self.hash, STEP), at, at + n, STEP)

    def bytes_of(self, i: int, j: int) -> bytes:
        """The text from word ``i`` to before word ``j``."""
        return self.data[self.start[i]:self.end[j - 1]].tobytes() if j > i else b""


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)), bounds


def chunks(bounds: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(column: pa.Array, table: np.ndarray) -> Iterator[Words]:
    data, bounds = string_parts(column)
    for i, j in chunks(bounds):
        own = bounds[i:j + 1] - bounds[i]
        raw = data[bounds[i]:bounds[j]]
        seen = table[raw]
        inside = seen != 32
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = own[:-1][own[:-1] < own[1:]]
        before[filled] = False
        after[own[1:][own[:-1] < own[1:]] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        sums = runs(_BYTE[seen], BASE)
        yield Words(i, j - i, np.searchsorted(own[1:], start, "right"), start, end, span(sums, start, end, BASE), raw, own)
