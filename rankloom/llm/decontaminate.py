"""Benchmark decontamination with one Aho-Corasick automaton over test items.

Texts and items are normalised alike: A-Z to a-z, then words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
An item's windows are its runs of 13 words, or all its words if it has fewer.  The words of
all windows get numbers; the automaton reads word numbers, so a match ends at a word and
maps back to characters of the original text.  A text is read once.

The automaton is built in each Python worker from the windows, which are broadcast.  Their
number is checked: items beyond ``MOST_WINDOWS`` windows make further automata, and the texts
pass one after the other, with what was hit so far written to the shared folder in between.

Nulls: a null text has no words and hits nothing; an item without id or without words has
no window.  Equal rows are judged alike.  Items with the same words all count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .frames import Stored, add_columns, field

WINDOW = 13
#: A text is contaminated when 1/20 of its words or more are hit.
SHARE = 20
#: Windows of one automaton: at 13 numbers each it stays below about 400 MB.
MOST_WINDOWS = 400_000

WORDS = vec.byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

SPAN = T.ArrayType(T.StructType([field("start", T.IntegerType()), field("end", T.IntegerType())]))
FIELDS = [
    field("n_words", T.LongType()),
    field("n_hit", T.LongType()),
    field("items", T.ArrayType(T.StringType())),
    field("spans", SPAN),
]


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> Iterator[list[tuple]]:
    """Blocks of (words, item ids), of ``MOST_WINDOWS`` windows at most; one block at least."""
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string"), F.col(text))
    found: dict[tuple, set] = {}
    names: dict[bytes, bytes] = {}
    pending, some = rows.toLocalIterator(), False
    for chunk in iter(lambda: [r for _, r in zip(range(1000), pending)], []):
        words = vec.words_of(pa.array([r[1] for r in chunk], pa.string()), WORDS, lower=True)
        for i, r in enumerate(chunk):
            spans = slice(words.first[i], words.first[i + 1])
            own = [words.data[s:e].tobytes() for s, e in zip(words.starts[spans].tolist(), words.ends[spans].tolist())]
            own = [names.setdefault(w, w) for w in own]
            for at in range(max(1, len(own) - size + 1) if own else 0):
                found.setdefault(tuple(own[at : at + size]), set()).add(r[0])
                if len(found) >= MOST_WINDOWS:
                    yield [(k, tuple(v)) for k, v in found.items()]
                    found, names, some = {}, {}, True
    if found or not some:
        yield [(k, tuple(v)) for k, v in found.items()]


class Scanner:
    """The automaton of one block."""

    def __init__(self, patterns: list[tuple]):
        every = sorted({w for p, _ in patterns for w in p})
        self.data = np.frombuffer(b"".join(every), np.uint8)
        ends = np.cumsum([len(w) for w in every], dtype=np.int64)
        starts = ends - np.array([len(w) for w in every], dtype=np.int64)
        hashes = vec.spans_hash(self.data, starts, ends)
        order = np.argsort(hashes)
        self.vocabulary, self.starts, self.ends = hashes[order], starts[order], ends[order]
        number = {every[k]: i + 1 for i, k in enumerate(order.tolist())}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, items in patterns:
            self.automaton.add_word(tuple(number[w] for w in p), (len(p), items))
        if patterns:
            self.automaton.make_automaton()
        self.shortest = min((len(p) for p, _ in patterns), default=0)

    def scan(self, words: vec.Words) -> tuple[np.ndarray, dict[int, set]]:
        """Which words are hit, and the items found in each row."""
        hit = np.zeros(len(words.hashes), dtype=bool)
        found: dict[int, set] = {}
        if not self.shortest or not len(hit):
            return hit, found
        at = np.searchsorted(self.vocabulary, words.hashes)
        at[at == len(self.vocabulary)] = 0
        numbers = np.where(self.vocabulary[at] == words.hashes, at + 1, 0)
        rows = words.row_of()
        begins, lengths = self._stretches(numbers, rows)
        if not len(begins):
            return hit, found
        # What may be part of a match is compared byte by byte.
        some = np.repeat(begins, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        k = at[some]
        same = vec.same_spans(words.data, words.starts[some], words.ends[some], self.data, self.starts[k], self.ends[k])
        if not same.all():
            numbers[some[~same]] = 0
            begins, lengths = self._stretches(numbers, rows)
        for s, n in zip(begins.tolist(), lengths.tolist()):
            for end, (length, items) in self.automaton.iter(tuple(numbers[s : s + n].tolist())):
                hit[s + end - length + 1 : s + end + 1] = True
                found.setdefault(int(rows[s]), set()).update(items)
        return hit, found

    def _stretches(self, numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and lengths of stretches of known words of one row: a match lies in one that is as long as the shortest window."""
        known = np.flatnonzero(numbers)
        if not len(known):
            return known, known
        breaks = np.flatnonzero((np.diff(known) != 1) | (np.diff(rows[known]) != 0)) + 1
        begins, lengths = known[np.r_[0, breaks]], np.diff(np.r_[0, breaks, len(known)])
        long = lengths >= self.shortest
        return begins[long], lengths[long]


_scanners: dict[str, Scanner] = {}


def _spans(words: vec.Words, offsets: np.ndarray, edges: list[int], row: int) -> list[dict]:
    """Runs of hit words of a row, as code points of the original text."""
    a = words.first[row]
    data = words.data[offsets[row] : offsets[row + 1]]
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return [
        {"start": int(points[words.starts[a + s] - offsets[row]]), "end": int(points[words.ends[a + e - 1] - offsets[row]])}
        for s, e in zip(edges[::2], edges[1::2])
    ]


#: Runs of hit words so far: the first word of each and the one after it, in turn.
_RUNS = field("_runs", T.ArrayType(T.IntegerType()))


def _scanned(docs: DataFrame, patterns: list[tuple], text: str, again: bool) -> DataFrame:
    """docs with n_words, n_hit, items, spans and _runs; again: with what they have of these already."""
    sent = docs.sparkSession.sparkContext.broadcast(patterns)
    key = uuid.uuid4().hex
    before = docs.withColumnsRenamed({"items": "_items_before", "_runs": "_runs_before"}) if again else docs
    keep = [c for c in before.columns if c not in {f.name for f in FIELDS}]

    def make():
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(sent.value)
        scanner = _scanners[key]

        def work(part: pa.RecordBatch) -> list:
            column = part.column(part.schema.get_field_index(text))
            words = vec.words_of(column, WORDS, lower=True)
            hit, found = scanner.scan(words)
            if again:
                earlier, items = (part.column(part.schema.get_field_index(c)) for c in ("_runs_before", "_items_before"))
                for row in np.flatnonzero(pc.list_value_length(earlier).to_numpy(zero_copy_only=False)).tolist():
                    runs = earlier[row].as_py()
                    for s, e in zip(runs[::2], runs[1::2]):
                        hit[words.first[row] + s : words.first[row] + e] = True
                    found.setdefault(row, set()).update(items[row].as_py())
            _, offsets = vec.flat(column)
            total = np.r_[0, np.cumsum(hit)]
            n = range(len(column))
            runs = [np.flatnonzero(np.diff(np.r_[False, hit[words.first[i] : words.first[i + 1]], False].astype(np.int8))).tolist() if i in found else [] for i in n]
            return [
                np.diff(words.first), total[words.first[1:]] - total[words.first[:-1]], [sorted(found.get(i, ())) for i in n],
                [_spans(words, offsets, runs[i], i) for i in n], runs,
            ]

        return work

    return add_columns(before, make, [*FIELDS, _RUNS], text, keep=keep).drop("_items_before", "_runs_before")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as text, sorted) and spans of hit words; columns of these names are replaced."""
    found = None
    for patterns in windows(benchmark, size=size):
        found = _scanned(docs, patterns, text, False) if found is None else _scanned(Stored(found).df, patterns, text, True)
    return found.drop("_runs")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    items = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    own = docs.columns
    spare = {c: f"_kept_{c}" for c in own if c in {f.name for f in FIELDS}}
    found = find(docs.withColumnsRenamed(spare), benchmark).where(~contaminated())
    return found.select(*[F.col(spare.get(c, c)).alias(c) for c in own])
