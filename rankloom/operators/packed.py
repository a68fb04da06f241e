"""The byte codec of ``functions.codec`` for a batch of streams at a time.

Streams stand one after the other: kinds (0 a rank, 1 an id, 2 a break), values, and where each stream begins (and the end).
"""

from __future__ import annotations

import re

import numpy as np

from rankloom.functions import codec

_UNIT = re.compile(rb"z{2,}|[zs]{2}|.")
_BYTES = re.compile(rb"[\x80-\xbf](?:[\x80-\xff]|[\x00-\x7f](?:[\x80-\xff]|[\x00-\x7f][\x80-\xff]|[\x00-\x7f])?)?|[\x00-\x7f\xc0-\xff]")


def _sizes(pattern: re.Pattern, data: bytes) -> np.ndarray:
    found = pattern.findall(data)
    return np.fromiter(map(len, found), np.int64, len(found))


def encode(kinds: np.ndarray, values: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all streams with their headers, and where each begins (and the end)."""
    if len(ends) == 1:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kinds, values = np.insert(kinds, ends[:-1], 1), np.insert(values.astype(np.int64), ends[:-1], window)  # a header is written as an id
    heads = ends[:-1] + np.arange(len(ends) - 1)
    if ((values < 0) | (values >= codec.EXPLICIT_4) | ((kinds == 0) & (values >= codec.RANKS))).any():
        raise ValueError("a rank is below 64, an id below 2**27")
    width = np.where(values < codec.EXPLICIT_2, ord("2"), np.where(values < codec.EXPLICIT_3, ord("3"), ord("4")))
    letters = np.where(kinds == 2, ord("B"), np.where(kinds == 1, width, np.where(values == 0, ord("z"), np.where(values < codec.SMALL, ord("s"), ord("L"))))).astype(np.uint8)
    n = _sizes(_UNIT, letters.tobytes())
    at = np.cumsum(n) - n
    letter, v = letters[at], values[at]
    two = n > 1
    run = two & (letter == ord("z")) & (letters[np.minimum(at + 1, len(letters) - 1)] == ord("z"))
    pair = two & ~run
    size = np.where(run, -(-n // codec.RUN_MOST), np.where((letter >= ord("2")) & (letter <= ord("4")), letter - ord("0"), 1))
    stop = np.cumsum(size)
    start = stop - size
    out = np.full(int(stop[-1]), 0xFE, np.uint8)
    one = ~two
    out[start[one]] = np.where(letter[one] == ord("B"), 0xFF, v[one] & 0xFF)
    out[start[pair]] = 0x40 | (v[pair] << 3) | values[at[pair] + 1]
    out[stop[run] - 1] = 0xC0 + (n[run] - 1) % codec.RUN_MOST + 1
    for bytes_ in (2, 3, 4):
        own = np.flatnonzero(letter == ord("0") + bytes_)
        for i in range(bytes_):
            high = 0x80 if i in (0, bytes_ - 1) else 0
            out[start[own] + i] = (v[own] >> 7 * (bytes_ - 1 - i)) & (63 if i == 0 else 127) | high
    return out, np.r_[start[np.searchsorted(at, heads)], stop[-1]].astype(np.int64)


def head(window: int) -> bytes:
    """The header of a stream."""
    return encode(np.empty(0, np.int8), np.empty(0, np.int32), np.zeros(2, np.int64), window)[0].tobytes()


def last_break(raw: bytes) -> int:
    """Where the last break between chunks stands in the beginning of a stream; 0: nowhere."""
    n = _sizes(_BYTES, raw)
    at = np.cumsum(n) - n
    found = at[np.frombuffer(raw, np.uint8)[at] == 0xFF]
    return int(found[-1]) if len(found) else 0


def decode(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """Of each stream of bytes its window; kinds, values and where streams begin (and the end); and why a stream is not whole."""
    own = [_sizes(_BYTES, raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    units = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int64)
    n = np.concatenate([np.empty(0, np.int64), *own])
    at = np.cumsum(n) - n
    data = np.frombuffer(raw, np.uint8)
    first = data[at].astype(np.int64)
    ids = (first & 0xC0) == 0x80
    value = first & 63
    for i in (1, 2, 3):
        more = np.flatnonzero(ids & (n > i))
        value[more] = (value[more] << 7) | (data[at[more] + i] & 127)
    cut = ids & ((n < 2) | (data[at + n - 1] < 0x80)) if len(at) else ids
    count = np.where((first >= 0x40) & (first < 0x80), 2, np.where((first >= 0xC0) & (first < 0xFF), first & 63, 1))
    heads = np.flatnonzero(np.diff(bounds) >= 2)
    heads = heads[ids[units[heads]]]
    windows, headed = np.full(len(bounds) - 1, codec.WINDOW, np.int64), np.zeros(len(bounds) - 1, bool)
    windows[heads], headed[heads] = value[units[heads]], True
    count[units[heads]] = 0
    stop = np.cumsum(count)
    start = stop - count
    total = int(stop[-1]) if len(stop) else 0
    kinds, values = np.zeros(total, np.int8), np.zeros(total, np.int32)
    one = count == 1
    plain = one & (first < 0x40)
    values[start[plain]] = first[plain]
    given = one & ids
    kinds[start[given]], values[start[given]] = 1, value[given]
    kinds[start[first == 0xFF]] = 2
    pair = (first >= 0x40) & (first < 0x80)
    values[start[pair]], values[start[pair] + 1] = (first[pair] >> 3) & 7, first[pair] & 7
    broken = np.add.reduceat(np.r_[cut, False].astype(np.int64), units[:-1]) if len(units) > 1 else np.empty(0, np.int64)
    broken = np.where(np.diff(units) > 0, broken, 0)
    faults = ["no header" if not h else "cut off inside an id" if c else None for h, c in zip(headed.tolist(), broken.tolist())]
    return windows, kinds, values, np.r_[0, stop][units], faults
