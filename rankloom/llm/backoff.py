"""Language-model scores by stupid backoff, computed relationally.

The model is the corpus's own: counts of all its words and word pairs (A-Z lower-cased).  A
word w after v scores n(v w) / n(v) if the pair occurs ``LEAST`` times or more, else
``ALPHA`` * n(w) / N; the first word scores n(w) / N.  A document's score is the mean of its
words' logarithms.

1. Words are counted: hashes with their counts in a slice, summed by hash.
2. Frequent words, at most ``FREQUENT``, get numbers and are broadcast with their counts.
3. Pairs are exploded from every document with their count in it, and shuffled once by the
   hash of the pair: two numbers of 20 bits where both words are frequent, two hashes
   otherwise.  The partition that gets a pair has its count table, and the join is in place.
4. A pair's score lacks one word's count: v's if the pair counts, else w's.  It is looked up
   among the frequent words, or joined by hash for the others.
5. Scores are summed for each document.

Nulls: a null text has no words; without words the score is null.  Rows equal in id and
text get the same score.  Rows without id are told apart by their text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vec
from .frames import Stored, packed, partitions, unpacked

ALPHA, LEAST = 0.4, 2
#: Words that are broadcast, at most: 6 MB.  A number has 20 bits.
FREQUENT, BITS = 1 << 19, 20


def _keys(part: pa.RecordBatch) -> np.ndarray:
    """A key for each row from its id and text hash."""
    id_, hash_ = (part.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
    return vec.mix(hash_ ^ vec.mix(id_ + np.uint64(1))).view(np.int64)


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the hash of each word and its count."""

    def run(batches):
        for batch in batches:
            hashes, counts = [], []
            for part in vec.slices(batch, text):
                h, n = np.unique(vec.words_of(part.column(0), lower=True).hashes, return_counts=True)
                hashes.append(h)
                counts.append(n)
            if hashes:
                h, at = np.unique(np.concatenate(hashes), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, np.concatenate(counts)).astype(np.int64))], ["word", "n"])

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent words: all from some count on, at most ``most``."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)  # some hundred rows, whatever the input
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    got = counts.where(step >= least).toArrow()  # at most ``most`` rows
    word, n = (got.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(word)
    return word[order], n[order]


def _pairs(keyed: DataFrame, words: np.ndarray, both_frequent: bool, parts: int) -> DataFrame:
    """Packed pairs with their key's row and their count there; the first word of a text is a pair with v = 0."""
    sent = keyed.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        known = sent.value
        for batch in batches:
            for part in vec.slices(batch, "text"):
                keys = _keys(part)
                w = vec.words_of(part.column(2), lower=True)
                if not len(w.hashes):
                    continue
                h, rows = w.hashes.view(np.int64), w.row_of()
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                number = np.where(known[at] == h, at, -1) if len(known) else np.full(len(h), -1)
                starts = np.r_[True, rows[1:] != rows[:-1]]
                before = lambda x, none: np.r_[[none], x[:-1]]
                code_v = np.where(starts, -1, before(number, -1))
                pick = ((code_v >= 0) & (number >= 0)) == both_frequent
                row = rows[pick]
                if both_frequent:
                    x = (code_v[pick].astype(np.int64) << BITS) | number[pick]
                    pair = vec.mix(x.astype(np.uint64))
                else:
                    v, own = np.where(starts, 0, before(h, 0))[pick], h[pick]
                    pair = vec.mix(vec.mix(v.view(np.uint64)) ^ own.view(np.uint64))
                order = np.lexsort((pair, row))
                pair, row = pair[order], row[order]
                fresh = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.empty(0, np.int64)
                times = np.diff(np.r_[fresh, len(row)]).astype(np.int32)
                which, key = order[fresh], keys[row[fresh]]
                if both_frequent:
                    x = x[which]
                    high = ((x >> 36 & 15) << 4) | (x >> 16 & 15)
                    columns = [(x >> BITS).astype(np.uint16).view(np.int16), x.astype(np.uint16).view(np.int16), high.astype(np.uint8).view(np.int8)]
                    yield from packed(pair[fresh], parts, ["v", "w", "high", "key", "times"], [*columns, key, times])
                else:
                    yield from packed(pair[fresh], parts, ["v", "w", "key", "times"], [v[which], own[which], key, times])

    kinds = "v array<smallint>, w array<smallint>, high array<tinyint>" if both_frequent else "v array<long>, w array<long>"
    rows = unpacked(keyed.mapInArrow(run, f"bucket int, {kinds}, key array<long>, times array<int>"), parts, ["v", "w", *(["high"] if both_frequent else []), "key", "times"])
    if not both_frequent:
        return rows
    high = F.col("high").cast("long").bitwiseAND(255)
    wide = lambda low, top: F.shiftleft(top, 16) + F.col(low).cast("long").bitwiseAND(65535)
    pair = F.shiftleft(wide("v", F.shiftright(high, 4)), BITS) + wide("w", high.bitwiseAND(15))
    return rows.select("bucket", pair.alias("pair"), "key", "times")


def _bases(keyed: DataFrame) -> DataFrame:
    """(id, key, n_words) of each row."""

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                n = np.diff(vec.words_of(part.column(2)).first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_keys(part)), pa.array(n)], ["id", "key", "n_words"])

    return keyed.mapInArrow(run, "id long, key long, n_words long")


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", alpha: float = ALPHA, least: int = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """id, n_words and score (mean natural logarithm; null without words) of each row."""
    if least < 1 or not 0 < alpha <= 1 or not 0 < frequent <= 1 << BITS:
        raise ValueError("least is 1 or more, alpha from 0 to 1, frequent up to 2**BITS")
    spark, keyed = docs.sparkSession, _keyed(docs, id, text)
    parts = partitions(spark)
    counts = Stored(word_counts(docs, text)).df
    total = counts.agg(F.sum("n")).first()[0] or 0
    words, times = _frequent(counts, frequent)
    known = spark.createDataFrame(pa.table({"number": np.arange(len(words)), "n": times}))
    log_all = math.log(total) if total else 0.0

    def scored(n: str) -> Column:
        """hit: the pair counts; n: the count that its score lacks."""
        return F.col("times") * F.when(F.col("hit"), F.log("pairs") - F.log(n)).otherwise(F.lit(math.log(alpha) - log_all) + F.log(n))

    one = _pairs(keyed, words, True, parts).withColumn("pairs", F.sum("times").over(Window.partitionBy("pair", "bucket"))).withColumn("hit", F.col("pairs") >= least)
    one = one.withColumn("number", F.when(F.col("hit"), F.shiftright("pair", BITS)).otherwise(F.col("pair").bitwiseAND((1 << BITS) - 1)))
    one = one.join(F.broadcast(known), "number").select("key", scored("n").alias("part"))  # FREQUENT rows at most
    two = _pairs(keyed, words, False, parts).withColumn("pairs", F.sum("times").over(Window.partitionBy("w", "v", "bucket")))
    two = two.withColumn("hit", (F.col("pairs") >= least) & (F.col("v") != 0)).withColumn("word", F.when(F.col("hit"), F.col("v")).otherwise(F.col("w")))
    first = F.when(F.col("v") == 0, F.col("times") * -math.log(alpha)).otherwise(0.0)  # the first word is not discounted
    two = two.select("key", "times", "pairs", "hit", "word", first.alias("first")).join(counts, "word").select("key", (scored("n") + F.col("first")).alias("part"))
    sums = one.union(two).groupBy("key").agg(F.sum("part").alias("part"))
    bases = _bases(keyed)
    copies = bases.groupBy("key").agg(F.count("*").alias("copies"))
    rows = bases.join(copies.join(sums, "key", "left"), "key", "left")
    mean = F.col("part") / F.col("copies") / F.when(F.col("n_words") > 0, F.col("n_words"))
    return rows.select(F.col("id").alias(id), "n_words", mean.alias("score"))
