"""Words of whole batches of texts as 64-bit hashes, by NumPy over Arrow's buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D. In UTF-8 those six bytes occur only as
themselves, so splitting bytes splits characters alike. A word's hash sums its eight-byte pieces, each mixed with its place before
it is added, so that no rule of letters and places makes two words equal; words of up to eight bytes differ as sure as their pieces do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at a time; the arrays of one piece then stay in the cache. One text is never split.
PIECE = 1 << 20
_MULT = U64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Marks that ``Words`` parts from the end of a word, and what must stand before them.
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each output bit depends on each input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, bytes beyond the end being zero; a view."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number for each stretch of bytes; none is empty."""
    size = end - start
    pieces_of = (size + 7) >> 3
    upto = np.cumsum(pieces_of)
    first = upto - pieces_of
    k = np.arange(upto[-1]) - np.repeat(first, pieces_of)
    x = eights(raw)[np.repeat(start, pieces_of) + 8 * k]
    x[upto - 1] &= _HEAD[size - 8 * (pieces_of - 1)]
    later = np.flatnonzero(k)
    x[later] ^= mix(k[later].astype(U64) * _MULT)
    return mix(np.add.reduceat(mix(x + _MULT), first) + size.astype(U64) * _MULT)


def same_bytes(raw: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``start`` on are those from ``other`` on, stretch by stretch."""
    wide, out, at = eights(raw), np.ones(len(start), bool), np.arange(len(start))
    done = 0
    while len(at):
        left = size[at] - done
        mask = _HEAD[np.minimum(left, 8)]
        out[at] &= (wide[start[at] + done] & mask) == (wide[other[at] + done] & mask)
        at = at[(left > 8) & out[at]]
        done += 8
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PIECE bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of rows i to j: ``hash`` and byte ``start`` and ``end`` of each, ``first`` word of each row (one more at the end).

    ``part``: a lone mark at a word's end, after an ASCII letter or digit, is a word of its own. ``apart``: the bytes that part words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, part: bool = False, apart: np.ndarray = _SPACE):
        base = offsets[0]
        raw = data[base : offsets[-1]]
        if lower:
            raw = _LOWER[raw]
        self.raw = raw
        edges = offsets - base
        space = apart[raw]
        n = len(raw)
        begins = ~space
        inner = begins[1:] & begins[:-1]
        firsts = edges[:-1][edges[:-1] < n]
        starts = begins.copy()
        starts[1:] &= ~inner
        starts[firsts] = begins[firsts]
        stops = begins.copy()
        stops[:-1] &= ~inner
        lasts = edges[1:][edges[1:] > 0] - 1
        stops[lasts] = begins[lasts]
        if part:
            mark = np.flatnonzero(_MARK[raw])
            mark = mark[stops[mark] & ~starts[mark]]
            mark = mark[_ALNUM[raw[mark - 1]]]
            starts[mark] = stops[mark - 1] = True
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, edges)
        self.hash = hashes(raw, self.start, self.end) if len(self.start) else np.zeros(0, U64)

    def __len__(self) -> int:
        return len(self.start)


def texts(column: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    data, offsets = buffers(column)
    for i, j in pieces(offsets):
        yield i, j, Words(data, offsets[i : j + 1], lower, apart=apart)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
