"""Substring dedup on a de Bruijn graph of word k-mers.

The edges are the windows of 35 words; a repeated edge is a window that starts in two
places or more, and every word under one is removed.

1. Anchors.  In each window the least of its 20-word hashes is its anchor; equal windows
   have equal anchors at equal offsets.  About one word in eight begins an anchor, and only
   anchors are counted at first: a window whose anchor occurs once can't be repeated.
2. Edges.  Windows with repeated anchors are hashed whole (96 bits) and counted.
3. Paths.  A window over each source stands in for the join of edges to successors on their
   nodes: an edge is put beside the next one, one word on in the same source.  While both
   occur equally often no source leaves or enters between them, so they compact into one
   nonbranching path with its source coordinates.
4. The coordinates are joined back to the texts, and the words under them removed.

Every count is made where the key's rows meet, and rows hold only numbers.  A task sends the first
two occurrences of a key there, which is enough to see that it is repeated; it knows that of
further ones and deals them by their place, so a passage that a third of all texts share is
spread over all partitions.  Texts are shuffled once, by document.

Nulls: a null text has no words.  Texts of fewer than 35 words lose nothing.  Equal rows
count as different places.  A text of any length is one row.  There are no ties, since all
copies go.  Columns beside id and text are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import vec
from .frames import add_columns, counted, field, packed, partitions, unpacked

WINDOW, ANCHOR = 35, 20


class Anchors:
    """Of each window of a slice: its first word, its row and its anchor's first word."""

    def __init__(self, column: pa.Array, window: int, anchor: int):
        self.words = w = vec.words_of(column)
        grams = vec.gram_hashes(w.hashes, anchor)
        rows = w.row_of()
        count = max(0, len(w.hashes) - window + 1)
        starts = np.arange(count)
        self.starts = starts[starts + window <= w.first[1:][rows[:count]]]
        self.rows = rows[self.starts]
        bits = np.uint64(max(20, len(grams).bit_length()))
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        span, have = window - anchor + 1, 1
        while have < span:  # the least of ever longer stretches
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        self.anchors = (low[self.starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        self.grams = grams


#: Keys that a task remembers to have sent, at most; beyond, it starts anew and sends some once more.
MOST_KEYS = 1 << 20


class Sent:
    """How often a task has sent each key so far: once, or twice and so not again."""

    def __init__(self):
        self.keys, self.times = np.empty(0, np.uint64), np.empty(0, np.int64)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Which of these occurrences are at least the third of their key."""
        unique, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(inverse, kind="stable")
        turn = np.empty(len(keys), np.int64)
        turn[order] = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
        at = np.searchsorted(self.keys, unique)
        old = np.flatnonzero(at < len(self.keys))
        old = old[self.keys[at[old]] == unique[old]]
        before = np.zeros(len(unique), np.int64)
        before[old] = self.times[at[old]]
        self.times[at[old]] = np.minimum(2, before[old] + count[old])
        fresh = np.setdiff1d(np.arange(len(unique)), old, assume_unique=True)
        if len(self.keys) + len(fresh) > MOST_KEYS:
            self.__init__()
        else:
            self.keys, self.times = np.insert(self.keys, at[fresh], unique[fresh]), np.insert(self.times, at[fresh], np.minimum(2, count[fresh]))
        return turn + before[inverse] >= 2


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def _numbers(part: pa.RecordBatch, row: np.ndarray) -> list[pa.Array]:
    """doc (nullable) and text_hash of these rows."""
    at = pa.array(row)
    return [part.column(0).take(at), part.column(1).take(at)]


def _deal(keys: np.ndarray, known: np.ndarray, text_hash: pa.Array, position: np.ndarray) -> np.ndarray:
    """Where rows go: by their key, and those that are known to be repeated by their place."""
    place = vec.mix(text_hash.to_numpy(zero_copy_only=False).view(np.uint64) + position.astype(np.uint64))
    return np.where(known, place, keys)


def _anchor_rows(docs: DataFrame, window: int, anchor: int, parts: int) -> DataFrame:
    names = ["anchor", "known", "doc", "text_hash", "position"]

    def run(batches):
        sent = Sent()
        for batch in batches:
            for part in vec.slices(batch, "text"):
                a = Anchors(part.column(2), window, anchor)
                if not len(a.starts):
                    continue
                at = np.unique(a.anchors)
                row = np.searchsorted(a.words.first, at, side="right") - 1
                doc, text_hash = _numbers(part, row)
                position = (at - a.words.first[row]).astype(np.int32)
                known = sent.known(a.grams[at])
                yield from packed(_deal(a.grams[at], known, text_hash, position), parts, names, [a.grams[at].view(np.int64), known.view(np.int8), doc, text_hash, position])

    return unpacked(docs.mapInArrow(run, "bucket int, anchor array<long>, known array<tinyint>, doc array<long>, text_hash array<long>, position array<int>"), parts, names)


def _edge_rows(docs: DataFrame, window: int, anchor: int, parts: int, exact: bool) -> DataFrame:
    """docs has ``positions``, of its repeated anchors.  exact: all of an edge's rows meet, so that they can be counted."""
    names = ["edge", "edge2", "known", "doc", "text_hash", "position"]

    def run(batches):
        sent = Sent()
        for batch in batches:
            for part in vec.slices(batch, "text"):
                a = Anchors(part.column(2), window, anchor)
                if not len(a.starts):
                    continue
                lists = part.column(3)
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                repeated = np.zeros(len(a.words.hashes), bool)
                repeated[a.words.first[row] + lists.flatten().to_numpy()] = True
                mask = repeated[a.anchors]
                starts, row = a.starts[mask], a.rows[mask]
                one = vec.gram_hashes(a.words.hashes, window)[starts]
                two = vec.gram_hashes(a.words.hashes, window, seed=0x5EED)[starts]
                doc, text_hash = _numbers(part, row)
                position = (starts - a.words.first[row]).astype(np.int32)
                known = np.zeros(len(one), bool) if exact else sent.known(vec.mix(one ^ two))
                columns = [one.view(np.int64), two.astype(np.uint32).view(np.int32), known.view(np.int8), doc, text_hash, position]
                yield from packed(_deal(one, known, text_hash, position), parts, names, columns)

    kinds = "bucket int, edge array<long>, edge2 array<int>, known array<tinyint>, doc array<long>, text_hash array<long>, position array<int>"
    return unpacked(docs.mapInArrow(run, kinds), parts, names)


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    return counted(rows, "places", *key).where("places > 1 or known > 0")


def _with_texts(keyed: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """The texts with what belongs to them.  Both uses shuffle the same columns alike, so Spark shuffles the texts once."""
    same = keyed["doc"].eqNullSafe(other["doc"]) & (keyed["text_hash"] == other["text_hash"])
    return keyed.join(other, same, how).drop(other["doc"], other["text_hash"])


def paths(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Compacted nonbranching paths of repeated edges: doc, text_hash, start (word), length (words), places, edge (the first)."""
    return _paths(_keyed(docs, id, text), window, anchor, True)


def _paths(keyed: DataFrame, window: int, anchor: int, exact: bool) -> DataFrame:
    """exact: with the number of places; else a path may go on where it branches, since only its words are asked for."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has from one word to the window's")
    parts = partitions(keyed.sparkSession)
    anchors = _repeated(_anchor_rows(keyed, window, anchor, parts), "anchor")
    flagged = anchors.groupBy("doc", "text_hash").agg(F.collect_list("position").alias("positions"))
    marked = _with_texts(keyed, flagged, "inner").select("doc", "text_hash", "text", "positions")
    edges = _repeated(_edge_rows(marked, window, anchor, parts, exact), "edge", "edge2")
    source = Window.partitionBy("doc", "text_hash").orderBy("position")
    follows = F.col("position") - F.lag("position").over(source) <= 1
    if exact:
        follows &= F.col("places") == F.lag("places").over(source)
    numbered = edges.withColumn("fresh", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("fresh").over(source))
    return numbered.groupBy("doc", "text_hash", "path").agg(
        F.min("position").alias("start"), (F.max("position") - F.min("position") + window).alias("length"),
        F.first("places").alias("places"), F.min_by("edge", "position").alias("edge"),
    ).drop("path")


FIELDS = [field("n_words", T.LongType()), field("n_removed", T.LongType()), field("kept", T.StringType()), field("kept_sha256", T.StringType())]


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept (words joined by one space; null without ``with_text``) and its kept_sha256."""
    keyed = _keyed(docs, id, text)
    spans = _paths(keyed, window, anchor, False).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    rows = _with_texts(keyed, spans, "left").select(F.col("doc").alias(id), "text", F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"))

    def make():
        def work(part: pa.RecordBatch) -> list:
            column = part.column(part.schema.get_field_index("text"))
            data, offsets = vec.flat(column)
            raw, out = data.tobytes(), ([], [], [], [])
            starts, lengths = (part.column(part.schema.get_field_index(n)) for n in ("starts", "lengths"))
            for i in range(len(column)):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n = len(words)
                if starts[i].is_valid:
                    gone = np.zeros(n + 1, dtype=np.int32)
                    at, size = np.array(starts[i].as_py()), np.array(lengths[i].as_py())
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + size, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:n]) == 0)]
                kept = b" ".join(words)
                for column_, v in zip(out, (n, n - len(words), kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest())):
                    column_.append(v)
            return [pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]

        return work

    return add_columns(rows, make, FIELDS, "text", keep=[id, "starts", "lengths"]).drop("starts", "lengths")
