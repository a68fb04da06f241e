"""Line dedup: a suffix array over line sequences by distributed prefix doubling.

A document is its sequence of lines (between line feeds) that hold a word; blank lines stay
where they are.  Suffixes of all documents are sorted by their first 1, 2, 4, ... lines:

* Rank 1 sorts the lines' 128-bit ids; the rank at 2h of a place sorts the pair (rank at h
  there, rank at h of the place h lines on).  Groups are sorted by range, and the row number in
  partition order is the rank, so ranks are in suffix order.
* Suffixes of equal rank at h are neighbours in the suffix array with a common prefix of h
  lines or more: the LCP interval of h.  Intervals of one suffix leave (discarding).  Rounds go
  on until no interval is left, whatever the longest repeat.
* Of an interval the first place, in the order of (doc_id, place), stays.  Every other place
  begins a later copy of h lines.

A maximal repeated run of h to 2h lines is what two later copies of h lines cover together, one
that begins with the run and one that ends with it, so whole runs are deleted, to their last
line.  A run counts from ``MIN_WORDS`` words on.  Where one of the two halves has fewer words
though the run has enough, the run's own interval is formed: its places agree in two ranks
that overlap.  That happens below 16 lines only, since each line has a word.

Nulls: a null text has no lines and stays null.  Rows without id come last in the order.
Rows equal in id and text are one document.  A document may repeat itself, also
overlapping.  A text of any length is one row; its lines are rows of numbers.  Ties in the
order are equal places.  Columns named as those added are replaced.  An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import vec
from .frames import Stored, add_columns, field, partitions

#: A run counts from so many words on.
MIN_WORDS = 10

_LINE = vec.byte_table(b"\n")
KEY = ["doc", "text_hash"]


class Lines:
    """The lines of a slice that hold a word: their row, number in it, words, place in the bytes."""

    def __init__(self, column: pa.Array):
        lines, words = vec.words_of(column, _LINE), vec.words_of(column)
        count = np.diff(np.searchsorted(words.starts, np.r_[lines.starts, len(lines.data)]))
        full = count > 0
        self.rows, self.count = lines.row_of()[full], count[full]
        self.starts, self.ends = lines.starts[full], lines.ends[full]
        n = len(lines.first) - 1
        self.first = np.searchsorted(self.rows, np.arange(n + 1))
        self.number = np.arange(len(self.rows)) - self.first[self.rows]
        self.data = lines.data

    def enough(self, min_words: int) -> np.ndarray:
        """Lines of the shortest run from each line on that has ``min_words`` words; 0 where the text ends before."""
        total = np.cumsum(self.count)
        end = np.searchsorted(total, total - self.count + min_words)
        return np.where(end < self.first[self.rows + 1], end - np.arange(len(end)) + 1, 0)

    def between(self, min_words: int) -> list[list[int]]:
        """Of each line the run lengths, no powers of two, that have enough words though one of their halves has not."""
        n = len(self.rows)
        enough = np.r_[self.enough(min_words), 0]
        rest = self.first[self.rows + 1] - np.arange(n)
        least = np.where(enough > 0, enough, np.iinfo(np.int64).max)  # lines that it takes
        out: list[list[int]] = [[] for _ in range(n)]
        h = 2
        while h < min_words:
            for length in range(h + 1, 2 * h):
                at = np.flatnonzero((rest >= length) & (least[:n] <= length))
                for i in at[(least[at] > h) | (least[at + length - h] > h)].tolist():
                    out[i].append(length)
            h *= 2
        return out


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def _line_rows(keyed: DataFrame, min_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                x = Lines(part.column(2))
                at = pa.array(x.rows)
                told = vec.spans_digest(x.data, x.starts, x.ends)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(x.number.astype(np.int32)), pa.array(x.enough(min_words).astype(np.int32)),
                     pa.array(x.between(min_words), pa.list_(pa.int32())), pa.array(told[:, 0]), pa.array(told[:, 1])],
                    ["doc", "text_hash", "place", "enough", "between", "x", "y"],
                )

    return keyed.mapInArrow(run, "doc long, text_hash long, place int, enough int, between array<int>, x long, y long")


_PLACE = ["doc", "text_hash", "place"]


def _place() -> Column:
    return F.struct(F.col("doc").isNull().alias("last"), *_PLACE)


def _intervals(rows: DataFrame, *key: str) -> DataFrame:
    """(key, first): of the keys that occur at two places or more, the first place."""
    found = rows.groupBy(*key).agg(F.min(_place()).alias("first"), F.max(_place()).alias("end"))
    return found.where("first <> end").drop("end")


def _later(rows: DataFrame, intervals: DataFrame, *key: str) -> DataFrame:
    """The rows in intervals, with ``later``: it isn't the first place.  Both sides are plain shuffles, so a hot key's rows are split."""
    return rows.join(intervals, [*key]).withColumn("later", _place() != F.col("first")).drop("first")


def _ranked(rows: DataFrame) -> Stored:
    """The rows whose (x, y) occurs at two places or more, with rank and later: ranks are in the order of (x, y)."""
    spread = _intervals(rows, "x", "y").repartitionByRange(partitions(rows.sparkSession), "x", "y").sortWithinPartitions("x", "y")
    ranks = Stored(spread.withColumn("rank", F.monotonically_increasing_id()))  # written once: a retry can't number them anew
    kept = Stored(_later(rows, ranks.df, "x", "y").drop("x", "y"))
    ranks.drop()
    return kept


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies: doc, text_hash, place and length in lines that hold a word.  Those that overlap make up maximal repeated runs."""
    return _runs(_keyed(docs, id, text), min_words)


def _runs(keyed: DataFrame, min_words: int) -> DataFrame:
    level = _ranked(_line_rows(keyed, min_words))
    order = Window.partitionBy(*KEY).orderBy("place")
    found, h = [], 1
    while not level.df.isEmpty():
        found.append(level.df.where(F.col("later") & F.col("enough").between(1, h)).select(*_PLACE, F.lit(h).alias("length")))
        # The rank so many lines on; equal rows agree.
        at = lambda step: F.max("rank").over(order.rangeBetween(step, step))
        steps = [F.when(F.array_contains("between", h + o), F.struct(F.lit(h + o).alias("length"), at(o).alias("over"))) for o in range(1, h)] if h < min_words else []
        seen = level.df.select(*_PLACE, "enough", "between", "rank", at(h).alias("next"), *([F.array(*steps).alias("runs")] if steps else []))
        if steps:
            own = seen.select(*_PLACE, "rank", F.inline(F.filter("runs", lambda r: r["over"].isNotNull())))
            named = Stored(own).df
            both = Stored(_intervals(named, "rank", "over", "length")).df
            found.append(_later(named, both, "rank", "over", "length").where("later").select(*_PLACE, "length"))
        # Places whose next h lines, or themselves, occur once can't be equal to another: they are gone already.
        level = _ranked(seen.where("next is not null").select(*_PLACE, "enough", "between", F.col("rank").alias("x"), F.col("next").alias("y")))
        h *= 2
    every = found[0] if found else level.df.select(*_PLACE, F.lit(0).alias("length")).limit(0)
    for more in found[1:]:
        every = every.union(more)
    return every


FIELDS = [field("n_lines", T.LongType()), field("n_removed", T.LongType()), field("kept", T.StringType()), field("kept_sha256", T.StringType())]


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_lines, n_removed (of lines that hold a word), kept (the text without the deleted lines) and its kept_sha256.

    Columns of these names are replaced.
    """
    longest = _runs(_keyed(docs, id, text), min_words).groupBy(*_PLACE).agg(F.max("length").alias("length"))
    spans = longest.groupBy(*KEY).agg(F.collect_list(F.struct("place", "length")).alias("spans"))
    spans = spans.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("spans.place").alias("_starts"), F.col("spans.length").alias("_lengths"))
    own = [c for c in docs.columns if c not in {f.name for f in FIELDS}]
    same = docs[id].cast("long").eqNullSafe(spans["_doc"]) & (F.xxhash64(docs[text]) == spans["_hash"])
    rows = docs.join(spans, same, "left").select(*[docs[c] for c in own], "_starts", "_lengths")

    def make():
        def work(part: pa.RecordBatch) -> list:
            column, starts, lengths = (part.column(part.schema.get_field_index(n)) for n in (text, "_starts", "_lengths"))
            x = Lines(column)
            data, offsets = vec.flat(column)
            raw, out = data.tobytes(), ([], [], [], [])
            for i in range(len(column)):
                n = int(x.first[i + 1] - x.first[i])
                kept, gone = raw[offsets[i] : offsets[i + 1]], 0
                if starts[i].is_valid:
                    marks = np.zeros(n + 1, dtype=np.int32)
                    begin, size = np.array(starts[i].as_py()), np.array(lengths[i].as_py())
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + size, -1)
                    away = np.flatnonzero(np.cumsum(marks[:n]) > 0)
                    gone = len(away)
                    drop = set((x.starts[x.first[i] + away] - offsets[i]).tolist())
                    pieces, at = [], 0
                    for piece in kept.split(b"\n"):
                        if at not in drop:
                            pieces.append(piece)
                        at += len(piece) + 1
                    kept = b"\n".join(pieces)
                there = column[i].is_valid
                for column_, v in zip(out, (n, gone, kept.decode() if there else None, hashlib.sha256(kept).hexdigest())):
                    column_.append(v)
            return [pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]

        return work

    return add_columns(rows, make, FIELDS, text, keep=[*own, "_starts", "_lengths"]).drop("_starts", "_lengths")


def clean(docs: DataFrame) -> DataFrame:
    """The documents without later copies of maximal repeated runs, with their own columns; a document that loses all its lines goes."""
    names = {f.name for f in FIELDS}
    spare = {c: f"_kept_{c}" for c in docs.columns if c in names}
    done = dedup(docs.withColumnsRenamed(spare)).where("n_removed = 0 or n_removed < n_lines")
    made = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[(made[c] if c in made else F.col(spare.get(c, c))).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
