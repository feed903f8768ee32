"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of ASCII digits, letters and bytes of non-ASCII characters, after A-Z are
lower-cased. Hashes are polynomial over bytes and wrap at 64 bits; a prefix sum gives any range's hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that any bits of them can be compared or taken as random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_POWERS: dict[int, np.ndarray] = {}
#: powers of a base that a worker process keeps at most
KEPT = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 … base ** (n - 1)``, kept for the largest ``n`` up to ``KEPT`` asked for."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 2) - 1).bit_length()) if n <= KEPT else n
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= KEPT:
            _POWERS[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of bytes ``first`` to ``last`` (exclusive), the same wherever they stand."""
    raw = (sums[last] - sums[first]) * powers(INVERSE, len(sums))[first]
    return mix(raw + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and where each begins (and the end)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  #: lower-cased bytes of all texts
    begins: np.ndarray  #: first byte of each text, and the end of the last
    start: np.ndarray  #: first byte of each word
    end: np.ndarray
    first: np.ndarray  #: first word of each text, and the number of words

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_sums(self.data), self.start, self.end)

    def text(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()


def words_of(column: pa.Array) -> Words:
    raw, begins = raw_bytes(column)
    data = LOWER[raw]
    inside = INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, begins, start, end, np.searchsorted(start, begins))
