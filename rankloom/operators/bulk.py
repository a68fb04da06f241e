"""Texts cut into chunks and tokens a batch at a time, on their UTF-8 bytes.

The rules are those of ``functions.splitter`` and ``rankcoder.tokenize``, whose expressions look at one text at a
time.  Here a batch is one buffer of bytes, and its tokens are places in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rankloom.functions.splitter import SLACK

#: Bytes of texts that are worked on together, about.
BYTES = 4 << 20
_SPACE = rb"(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)+"
_PARAGRAPH = re.compile(rb"\n(?:\n|[-=*]{3,}\n)")
_SENTENCE = re.compile(rb"[\n.!?](?:(?<=\n)|\n|" + _SPACE + rb")")
#: Of each byte: white space, of a word, or another.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[list(b" \t\n\f\r")] = 0
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")] = 1


def _ends(pattern: re.Pattern, raw: bytes, start: int, stop: int) -> tuple[list[int], int]:
    """Where the pieces of a part of ``raw`` end, and how many of them end with a delimiter."""
    ends = [m.end() for m in pattern.finditer(raw, start, stop)]
    n = len(ends)
    if start < stop and (not n or ends[-1] < stop):
        ends.append(stop)
    return ends, n


def split(raw: bytes, bounds: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each chunk ends, and how many chunks each text has; a text is what lies between two of ``bounds``."""
    limit = SLACK * most
    points = None
    if not raw.isascii():
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        points = np.zeros(len(raw) + 1, np.int32 if len(raw) < 1 << 31 else np.int64)
        np.cumsum(lead, out=points[1:])
    told = (lambda at: at) if points is None else (lambda at: points[at].tolist())
    out: list[int] = []
    counts = np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a == b:
            continue
        ends, n = _ends(_PARAGRAPH, raw, a, b)
        whole = _packed(a, ends, told([a])[0], told(ends), least, most, n)
        rest, last = whole.pop(), whole[-1] if whole else None
        start, done = told([last[1] if last else a, b])
        if start < done:
            if last and done - start < least and done - told([last[0]])[0] <= limit:
                whole[-1] = (last[0], b)
            else:
                whole.append((rest[0], b))
        before = len(out)
        for low, high in whole:
            x, y = told([low, high])
            if y - x > limit:
                ends, _ = _ends(_SENTENCE, raw, low, high)
                parts = _packed(low, ends, x, told(ends), least, most, 0)
                out += [e for s, e in parts[:-1]]
                if parts[-1][0] < parts[-1][1]:
                    out.append(high)
            else:
                out.append(high)
        counts[i] = len(out) - before
    return np.array(out, np.int64), counts


def closed(raw: bytes, least: int, most: int) -> int:
    """Where the beginning of a text can be cut so that both sides, cut into chunks each alone, have the chunks of the whole; 0: nowhere.

    Packing begins anew behind each chunk that a delimiter between paragraphs closes.  The last of these stays on the right
    side: what follows may be a tail that joins it.
    """
    if least < 1:
        return 0
    ends, n = _ends(_PARAGRAPH, raw, 0, len(raw))
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=points[1:])
    whole = _packed(0, ends[:n], 0, points[ends[:n]].tolist(), least, most, n)[:-1]
    return whole[-2][1] if len(whole) > 1 else 0


def _packed(start: int, ends: list[int], first: int, points: list[int], least: int, most: int, n: int) -> list[tuple[int, int]]:
    """Pieces packed greedily: the chunks, and what is left.  The first ``n`` pieces close a chunk that is long enough."""
    out = []
    at, size = start, first
    before, prev = start, first
    for i, p in enumerate(points):
        if p - size > most and prev - size >= least:
            out.append((at, before))
            at, size = before, prev
        elif i < n and p - size >= least:
            out.append((at, ends[i]))
            at, size = ends[i], p
        before, prev = ends[i], p
    out.append((at, before))
    return out


def token_starts(raw: np.ndarray, bounds: np.ndarray, how: str = "words") -> np.ndarray:
    """Where the tokens of chunks begin: those of ``rankcoder.WORDS``, or code points.  ``bounds``: where chunks begin, and the end."""
    if not len(raw):
        return np.empty(0, np.int64)
    if how == "codepoints":
        return np.flatnonzero((raw & 0xC0) != 0x80)
    kinds = _CLASS[raw]
    begins = np.empty(len(raw), bool)
    begins[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    own = np.zeros(len(raw) + 1, bool)
    own[bounds] = True
    runs = np.flatnonzero(begins | own[:-1])
    alone = (kinds[runs[:-1]] == 0) & (np.diff(runs) == 1)  # one white-space character goes with what follows
    return runs[np.r_[True, ~(alone & ~own[runs[1:]])]]


def token_array(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The tokens as strings, in place."""
    ends = np.r_[starts, len(raw)].astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw))


def raw_bytes(strings: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of strings one after the other, and where each begins, with the end; null is nothing."""
    if strings.null_count:
        strings = strings.fill_null(b"" if pa.types.is_binary(strings.type) or pa.types.is_large_binary(strings.type) else "")
    large = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, at, data = strings.buffers()
    at = np.frombuffer(at, "<i8" if large else "<i4")[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    raw = memoryview(data)[at[0] : at[-1]].tobytes() if data is not None else b""
    return raw, at - at[0]


def parts(batch: pa.RecordBatch, cut: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of about ``BYTES`` bytes together: the rows, the bytes of their texts, where chunks begin (and the end), and each row's number of chunks.

    The last column has the texts, to be cut into chunks of ``cut``, or lists of chunks.
    """
    column = batch.column(batch.num_columns - 1)
    lists = pa.types.is_list(column.type)
    flat = column.flatten() if lists else column
    n = column.value_lengths().fill_null(0).to_numpy().astype(np.int64) if lists else np.ones(len(column), np.int64)
    raw, bounds = raw_bytes(flat)
    ends = np.r_[0, np.cumsum(n)]
    group = bounds[ends[1:]] // BYTES
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(column)].tolist()
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        own = bounds[ends[a] : ends[b] + 1]
        text, own = raw[own[0] : own[-1]], own - own[0]
        if lists:
            yield batch.slice(a, b - a), np.frombuffer(text, np.uint8), own, n[a:b]
        else:
            stops, counts = split(text, own, *cut)
            yield batch.slice(a, b - a), np.frombuffer(text, np.uint8), np.r_[0, stops], counts
