"""Words of an Arrow column as flat numpy arrays: where they stand, whose they are, and a 64-bit hash of each.

Everything here is a bounded helper inside a task: it sees one Arrow batch and holds a few arrays of its size.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# The white space bytes that part words, 0x09 to 0x0D and 0x20.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Keeps the first n of eight bytes read as a little-endian number.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
LONG_WORD = 64


def slices(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of whole texts of at most ``most`` bytes; a longer text is a run of its own."""
    until = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        done = until[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(until, done + most, side="right")))
        yield column.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other, and the offsets of the texts. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclasses.dataclass
class Words:
    """Words in reading order. ``doc`` is the row of each, ``first[d]:first[d + 1]`` are the words of row ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return hash_slices(self.data, self.starts, self.ends, seed)


def words_of(column, lower: bool = False, apart: np.ndarray = WHITE) -> Words:
    """The words of every text; ``apart`` marks the bytes between words, ``lower`` folds A-Z."""
    data, offsets = flat(column)
    if lower:
        data = LOWER[data]
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, starts, ends, doc, first)


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each slice of bytes: eight bytes a step, very long slices by a library."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix((eight[starts] & MASKS[np.minimum(length, 8)]) ^ (length.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
    live, at = np.flatnonzero(length > 8), 8
    while live.size and at < LONG_WORD:
        rest = length[live] - at
        out[live] = mix(out[live] * np.uint64(3) ^ eight[starts[live] + at] & MASKS[np.minimum(rest, 8)])
        live, at = live[rest > 8], at + 8
    for i in live:
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=seed)
    return out


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """A hash of every ``n`` neighbouring hashes, in order; runs on over the ends of texts, which callers mask."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, seed, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for k in range(n):
        out += hashes[k : k + count] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed 64-bit numbers that Spark has."""
    return x.view(np.int64)
