"""Texts of an Arrow batch as one byte buffer, with word and hash arithmetic on whole buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. These six
are ASCII, so splitting the UTF-8 bytes gives the same words as splitting the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

PIECE = 1 << 20
HASH_BLOCK = 1 << 16
# two independent hashes: two odd factors and a seed each
_FACTORS = tuple(
    tuple(np.uint64(x) for x in row)
    for row in (
        (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x2545F4914F6CDD1D),
        (0xD1B54A32D192ED03, 0x94D049BB133111EB, 0x5851F42D4C957F2D),
    )
)


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``limit`` bytes; null counts as empty.

    A text is never divided: one that is longer than ``limit`` makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    rows = len(column)
    if rows == 0:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        part = offsets[first : last + 1]
        yield first, data[part[0] : part[-1]], part - part[0]
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word never crosses from one text to the next."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = ~_SEPARATOR[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    before = np.concatenate(([True], ~inside[:-1])) | border[:-1]
    after = np.concatenate((~inside[1:], [True])) | border[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: neighbouring inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pair(left: np.ndarray, right: np.ndarray, which: int) -> np.ndarray:
    """One number for two, in this order. No sum of products: texts with structure must not cancel out."""
    out = left * _FACTORS[which][0]
    out += right
    out ^= out >> np.uint64(32)
    out *= _FACTORS[which][1]
    out ^= out >> np.uint64(29)
    return out


def _doubled(values: np.ndarray, which: int, wanted: set[int]) -> dict[int, np.ndarray]:
    """{k: hash of the 2**k symbols from each place on}, by pairs of pairs."""
    seed = _FACTORS[which][2]
    out = {}

    def climb(level: np.ndarray, k: int, last: int) -> None:
        while True:
            if k in wanted:
                out[k] = level
            if k >= last:
                return
            half = 1 << k
            level = _pair(level[: max(len(level) - half, 0)], level[half:], which)
            k += 1

    if values.dtype != np.uint8:
        climb(mix(values ^ seed), 0, max(wanted))
        return out
    small = {k for k in wanted if k < 3}
    if small:
        climb(mix(values.astype(np.uint64) ^ seed), 0, max(small))
    if len(small) < len(wanted):
        # eight bytes are one number
        count = max(len(values) - 7, 0)
        eight = np.ndarray((count,), dtype="<u8", buffer=np.ascontiguousarray(values), strides=(1,)) if count else np.zeros(0, dtype=np.uint64)
        climb(mix(eight ^ seed), 3, max(wanted))
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each span of symbols, wherever it stands; 0 and 1 name independent hashes.

    A span is two overlapping runs of 2**k symbols, which determine it. Runs are hashed block by block, so that a long
    text needs no more memory than a block and its longest span. Symbols are bytes or 64-bit numbers; spans are not empty.
    """
    starts, size = np.asarray(starts), np.asarray(ends) - np.asarray(starts)
    out = np.zeros(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    power = np.frexp(size.astype(np.float64))[1] - 1
    order = np.argsort(starts, kind="stable")
    in_order = starts[order]
    first = int(in_order[0])
    while first is not None:
        a, b = np.searchsorted(in_order, (first, first + HASH_BLOCK))
        mine = order[a:b]
        levels = _doubled(values[first : first + HASH_BLOCK + int(size[mine].max())], which, set(np.unique(power[mine]).tolist()))
        for k, level in levels.items():
            some = mine[power[mine] == k]
            at = starts[some] - first
            ends_at = at + size[some] - (1 << k)
            out[some] = _pair(_pair(level[at], level[ends_at], which), size[some].astype(np.uint64), which)
        first = int(in_order[b]) if b < len(order) else None
    return out


def gram_hashes(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of ``span_hashes`` for each run of ``size`` symbols."""
    k, count = size.bit_length() - 1, max(len(values) - size + 1, 0)
    shift, out = size - (1 << k), np.empty(count, dtype=np.uint64)
    for first in range(0, count, HASH_BLOCK):
        n = min(HASH_BLOCK, count - first)
        level = _doubled(values[first : first + n + size - 1], which, {k})[k]
        pairs = _pair(level[:n], level[shift : shift + n], which)
        out[first : first + n] = _pair(pairs, np.full(n, size, dtype=np.uint64), which)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(np.ascontiguousarray(data), starts, ends)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words of one text."""
    out = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25)) + words[i : len(words) - size + 1 + i]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
