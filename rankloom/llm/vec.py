"""Vectorised word and n-gram hashing over Arrow string columns.

Text never becomes a Python object: the UTF-8 bytes of a slice of rows are read as one
numpy array and words are found by a 256-entry byte table.  A word's bytes go through a
64-bit mixer eight at a time, in order, and so do the halves of an n-gram: nothing is a sum
over letters or places, so texts that defeat polynomial hashes are told apart too.  A seed
enters every step.  Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Steps that two halves, places and sizes are told apart by: odd numbers without a pattern.
_GRAM, _PLACE, _SIZE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F))
#: Bytes of a span that numpy mixes; longer ones are hashed one by one.
LONG = 64

#: Bytes of text looked at together; one longer text is taken alone.
SLICE_BYTES = 1 << 19


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    keep = np.ones(256, dtype=bool)
    keep[list(separators)] = False
    return keep


#: Words ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))

#: Bytes with A-Z mapped to a-z.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


@dataclass
class Words:
    """Words of consecutive rows: row i has words first[i]:first[i + 1]."""

    data: np.ndarray  # the bytes of all rows, lower-cased if asked for
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    first: np.ndarray  # int64, rows + 1
    hashes: np.ndarray  # uint64

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, keep: np.ndarray = SPACE_WORDS, lower: bool = False, seed: int = 0) -> Words:
    data, offsets = flat(column)
    n = len(data)
    if lower:
        data = ASCII_LOWER[data]
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.empty(0, np.uint64))
    inside = keep[data]
    edge = np.zeros(n + 1, dtype=bool)  # a row begins here
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, first.astype(np.int64), spans_hash(data, starts, ends, seed))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes of each span."""
    size, key = ends - starts, np.uint64(seed)
    out = mix(size.astype(np.uint64) * _SIZE + key)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        step = eight[starts[live] + at] & _FIRST[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ mix(step + _GRAM + key))
        live, at = live[left > 8], at + 8
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[s:e], seed) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def spans_digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits for each span, as two int64."""
    raw = memoryview(np.ascontiguousarray(data))
    told = b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(told, dtype="<i8").reshape(-1, 2)


def same_spans(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Whether span i of the bytes ``one`` equals span i of the bytes ``two``."""
    size = ends - starts
    same = size == ends2 - starts2
    some = np.flatnonzero(same & (size > 0))
    if len(some):
        n = size[some]
        total = np.cumsum(n)
        step = np.arange(total[-1]) - np.repeat(total - n, n)
        differ = one[np.repeat(starts[some], n) + step] != two[np.repeat(starts2[some], n) + step]
        same[some] = ~np.logical_or.reduceat(differ, total - n)
    return same


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each word on, for all but the last n - 1 words; rows are not looked at.

    Stretches of 1, 2, 4, ... words are put together from halves, and two that overlap make n words.
    """
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    key = np.uint64(seed)
    level, have = mix(hashes + key) if seed else hashes, 1
    while have < n:
        step = min(have, n - have)
        level = mix(level[: len(level) - step] ^ mix(level[step:] + _GRAM + key))
        have += step
    return level if n > 1 else mix(level)


def sequence_hash(hashes: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for the words first[i]:first[i + 1] of each row: each is mixed with its place, then summed."""
    size = np.diff(first)
    place = np.arange(first[0], first[-1]) - np.repeat(first[:-1], size)
    sums = np.zeros(len(place) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes[first[0] : first[-1]] ^ mix(place.astype(np.uint64) * _PLACE + _PLACE + np.uint64(seed))), out=sums[1:])
    at = first - first[0]
    return mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64) * _SIZE)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text."""
    column = batch.column(batch.schema.get_field_index(text))
    if len(column) == 0:
        return
    lengths = np.asarray(pc.binary_length(column.fill_null("")))
    total = np.cumsum(lengths)
    at = 0
    while at < len(column):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
