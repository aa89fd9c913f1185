"""Vectorised tokenising and hashing over the byte buffers of Arrow string columns.

Words are runs of bytes outside ``[\\t\\n\\f\\r ]``; hashes are polynomial over the
bytes (mod 2**64) and then mixed. Everything works on slices of a few MB, so
a worker's memory doesn't follow the batch or the longest text by much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
SLICE_BYTES = 2 << 20

WS = np.zeros(256, bool)
WS[[9, 10, 12, 13, 32]] = True
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALNUM[_a:_b] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = (np.arange(256, dtype=np.uint64) + U64(1)) * U64(0xD6E8FEB86659FD93)

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, SLICE_BYTES + 4096)
        _pow, _inv = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)))) for x in (_P, _PINV))
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_array(column) -> pa.Array:
    """One array with nulls read as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets, the first at 0."""
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    _, offsets, data = a.buffers()
    if len(a) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(a: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    _, off = raw(a)
    i, n = 0, len(a)
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; none crosses from one row to the next."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = off[:-1][off[:-1] < off[1:]]
    first[rows] = inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][off[:-1] < off[1:]] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of kept bytes of each span."""
    value = _VALUE[data]
    if kept is None:
        power, inverse = _powers(len(data) + 1)
        value *= power[: len(data)]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts]), ends - starts
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    power, inverse = _powers(int(before[-1]) + 2)
    value *= power[before[:-1]]
    value[~kept] = 0
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    at = before[starts]
    return mix((total[ends] - total[starts]) * inverse[at]), before[ends] - at


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters of Latin-1; lengths stay as they are."""
    out = _FOLD[data]
    if len(out) > 1:
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        b = out[second]
        out[second] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return out


def words(a: pa.Array, folded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each row and the end, bytes) of the words that have a letter or digit; other characters of ASCII inside a word don't count."""
    data, off = raw(a)
    starts, ends = runs(~WS[data], off)
    h, n = span_hash(fold(data) if folded else data, starts, ends, ALNUM[data])
    if (n == 0).any():
        some = n > 0
        h, starts, ends = h[some], starts[some], ends[some]
    return h, starts, ends, np.searchsorted(starts, off), data


def char_before(data: np.ndarray) -> np.ndarray:
    """Characters before each byte, and at the end their number."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class HashSet:
    """Membership and position of 64-bit hashes in a sorted array, with a table of bits before the search."""

    def __init__(self, keys: np.ndarray, bits: int | None = None):
        self.keys = np.unique(np.asarray(keys, np.uint64))
        self.mask = U64((1 << (bits or max(16, min(24, int(len(self.keys)).bit_length() + 5)))) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash in keys, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
            at = np.searchsorted(self.keys, h[maybe])
            at[at == len(self.keys)] = 0
            out[maybe] = np.where(self.keys[at] == h[maybe], at, -1)
        return out
