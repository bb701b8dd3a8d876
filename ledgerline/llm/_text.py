"""Words and their hashes for whole Arrow batches at once.

A word is a longest run of bytes outside ``\\x20\\x09-\\x0D``.  Everything here works on one slice of
a batch (about ``SLICE_BYTES`` of text, or one longer document), so memory follows the slice and not the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], _U)
_STEP, _BASE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_MIX_1, _MIX_2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_POWERS = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, element by element."""
    h = (h ^ (h >> _U(30))) * _MIX_1
    h = (h ^ (h >> _U(27))) * _MIX_2
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(1 << 18, 1 << (n + 1).bit_length())
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            table = np.full(size, base, _U)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of consecutive documents: byte ranges, hashes and where each document's words begin."""

    data: np.ndarray  # bytes, with 8 spare ones behind
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word; one more entry for the end
    bounds: np.ndarray  # byte offset of each document; one more entry for the end

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def doc_end(self) -> np.ndarray:
        """For each word, the index behind its document's last word."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = self.data
        if lower:
            data = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
        return run_hashes(data, self.starts, self.ends)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end); data has 8 spare bytes behind the last run."""
    size = ends - starts
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    h = size.astype(_U) * _STEP + _MIX_1
    which, at, left = slice(None), starts, size
    while len(at):
        lane = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        part = (h[which] ^ lane) * _STEP
        h[which] = part ^ (part >> _U(29))
        longer = np.flatnonzero(left > 8)
        which = longer if isinstance(which, slice) else which[longer]
        at, left = at[longer] + 8, left[longer] - 8
    return mix(h)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets of the rows in them) of slices of about ``most`` bytes."""
    column = strings(column)
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        data = np.zeros(int(offsets[to] - offsets[row]) + 8, np.uint8)
        data[:-8] = raw[offsets[row] : offsets[to]]
        yield row, to, data, offsets[row : to + 1] - offsets[row]
        row = to


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(data) - 8
    inside = ~_SPACE[data[:n]]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    behind = np.empty(n, bool)
    behind[-1:] = False
    behind[:-1] = inside[1:]
    last = bounds[1:] - 1
    behind[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~behind) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds), bounds)


def window_hashes(h: np.ndarray, doc_end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of ``width`` consecutive words that lies in one document."""
    at = np.flatnonzero(np.arange(len(h)) + width <= doc_end)
    if not len(at):
        return at, np.zeros(0, _U)
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return at, mix((total[at + width] - total[at]) * down[at] + _U(width))


def unique_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with first places and counts."""
    return np.unique(keys, return_index=True, return_counts=True)
