"""Tokenising, the rank model and the rank coder over chunk rows.

The model is a vocabulary and, for each context of up to ``ORDER`` tokens that training has seen,
a list of the tokens that followed it, the most frequent first.  The candidates of a place are the
lists of its contexts, the longest first, one after the other, up to 64; a window limits the
length of contexts.  A token's rank is where it first stands.

Every position of a chunk is coded from the tokens before it, so encoding is a lookup for each
length of context, of all tokens of a batch at a time; decoding takes one place of every chunk of
the batch at a time.  Nothing is shuffled.  A model has all tokens and lists of its training texts,
unless it is given a bound; tasks write it as arrays into the shared folder and map these into
memory (``store``).  What a bounded model leaves out is coded by explicit ids, and no text is lost.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from rankloom.functions import codec
from rankloom.functions.splitter import split_text
from rankloom.operators import bulk, packed
from rankloom.operators.store import ID_BITS, NONE, Store, context_keys
from rankloom.sources.tables import written

#: Fixed value: words, symbols and white space, each with one white-space character before it.
WORDS = r"[ \t\n\f\r]?[0-9A-Za-z_]+|[ \t\n\f\r]?[^ \t\n\f\r0-9A-Za-z_]+|[ \t\n\f\r]+"
#: Candidates of a place; tokens of the longest context.
CANDIDATES, ORDER = 64, 3
#: Contexts of several tokens list what followed them so often.
LEAST = 2
#: Bytes of texts, or tokens, that are worked on together.
LETTERS = 1 << 20
#: Bytes of payloads that are decoded together.
SHARE = 2 << 20


class Tokenizer(Protocol):
    """Text to ids and back, in Python: for models from outside."""

    def tokenize(self, text: str) -> list[int]: ...

    def detokenize(self, ids: list[int]) -> str: ...


class RankModel(Tokenizer, Protocol):
    """A tokenizer that also says what may follow: for each context the candidates, best first, at most 64."""

    def top_k(self, contexts: list[list[int]]) -> list[Sequence[int]]: ...


def tokenize(text: Column, how: str = "words") -> Column:
    """Tokens of a text: ``words``, or ``codepoints``."""
    if how == "codepoints":
        return F.filter(F.split(text, ""), lambda c: c != "")
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def chunk_rows(docs: DataFrame, least: int = 100, most: int = 500, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_no and chunk of every chunk."""
    return docs.select(F.col(id).alias("doc_id"), F.posexplode(split_text(F.col(text), least, most)).alias("chunk_no", "chunk"))


def token_rows(chunks: DataFrame, how: str = "words") -> DataFrame:
    """doc_id, chunk_no, pos and token of every token."""
    return chunks.select("doc_id", "chunk_no", F.posexplode(tokenize(F.col("chunk"), how)).alias("pos", "token"))


def vocabulary(tokens: DataFrame, most: int | None = None) -> DataFrame:
    """token, n and token_id of all tokens, or of the ``most`` most frequent: ids by falling count, then by token.  ``tokens`` may be counted: n.

    Ids are dense.  Tokens are sorted by range, and the sizes of the partitions before are added, so no task
    sees all tokens.
    """
    if most is not None and not 0 < most < (1 << ID_BITS) - 0x110000 - 1:
        raise ValueError("the bound of a vocabulary is lower than that")
    counts = tokens.groupBy("token").agg((F.sum("n") if "n" in tokens.columns else F.count("*")).alias("n"))
    order = [F.desc("n"), F.asc("token")]
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number is a partition in its high bits and a row below; it is written once, so all see the same.
    rows = written(placed.withColumn("_at", F.monotonically_increasing_id()))
    first = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_size"))  # a row for each partition
    before = first.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    numbered = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    made = numbered.select("token", "n", (F.col("_before") + own).cast("int").alias("token_id"))
    return made if most is None else made.where(F.col("token_id") < most)


def _size(vocab: DataFrame) -> DataFrame:
    return F.broadcast(vocab.agg((F.coalesce(F.max("token_id"), F.lit(-1)) + 1).alias("_size")))


def word_ids(words: DataFrame, vocab: DataFrame, column: str = "word") -> DataFrame:
    """``words`` with ids: the vocabulary's id of the word, or its code points above the vocabulary."""
    points = F.transform(F.filter(F.split(column, ""), lambda c: c != ""), lambda c: F.ascii(c) + F.col("_size"))
    known = words.join(vocab.select(F.col("token").alias(column), "token_id"), column, "left").join(_size(vocab))
    return known.select(*words.columns, F.when(F.col("token_id").isNotNull(), F.array("token_id")).otherwise(points).alias("ids"))


def id_words(rows: DataFrame, vocab: DataFrame, column: str = "token_id") -> DataFrame:
    """``rows`` with word: what an id stands for."""
    known = rows.join(vocab.select(F.col("token_id").alias(column), "token"), column, "left").join(_size(vocab))
    point = F.decode(F.unhex(F.lpad(F.hex(F.col(column) - F.col("_size")), 8, "0")), "UTF-32")
    return known.select(*rows.columns, F.coalesce("token", point).alias("word"))


def context_rows(items: DataFrame, window: int, column: str = "token_id") -> DataFrame:
    """Items with ``context``: up to ``window`` of them before it in its chunk."""
    frame = Window.partitionBy("doc_id", "chunk_no").orderBy("pos").rowsBetween(-window, -1)
    return items.withColumn("context", F.collect_list(column).over(frame))


def reach(window: int) -> int:
    """Tokens of the longest context that a window lets through."""
    if not 1 <= window < codec.EXPLICIT_4:
        raise ValueError("a window is from 1 to 2**27 - 1")
    return min(window, ORDER)


def coded_ids(raw: np.ndarray, bounds: np.ndarray, store: Store, how: str = "words") -> tuple[np.ndarray, np.ndarray]:
    """The ids of all chunks' tokens one after the other, and how many each chunk has; ``bounds``: where chunks begin in ``raw``, and the end.

    Tokens outside the vocabulary become code points above it.
    """
    starts = bulk.token_starts(raw, bounds, how)
    sizes = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.empty(0, np.int64), sizes
    words = bulk.token_array(raw, starts).dictionary_encode()
    ids = store.token_ids(words.dictionary)[words.indices.to_numpy()]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        points = [[ord(x) + store.size for x in t] for t in words.take(pa.array(odd)).to_pylist()]
        n = np.ones(len(ids), np.int64)
        n[odd] = [len(p) for p in points]
        ends = np.r_[0, np.cumsum(sizes)]
        wide = np.repeat(ids, n)
        wide[wide < 0] = [x for p in points for x in p]
        ids, sizes = wide, np.diff(np.r_[0, np.cumsum(n)][ends])
    return ids, sizes


def _places(sizes: np.ndarray) -> np.ndarray:
    """Each token's place in its chunk."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _keys(ids: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    return context_keys([np.roll(ids, j) for j in range(1, ORDER + 1)], [pos >= j for j in range(1, ORDER + 1)])


def _groups(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of about ``LETTERS`` bytes together: their bytes, and where they begin."""
    cuts = np.r_[0, np.flatnonzero(np.diff(bounds[1:] // LETTERS)) + 1, len(bounds) - 1].tolist()
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]


def word_counts(docs: DataFrame, how: str, cut: tuple[int, int]) -> DataFrame:
    """token and n: how often tokens are in the chunks of texts, in several rows."""

    def run(batches):
        for batch in batches:
            for _, raw, bounds, _ in bulk.parts(batch, cut):
                found = bulk.token_array(raw, bulk.token_starts(raw, bounds, how)).value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long")


#: Tokens that a task counts together, and rows of ``gram_rows`` that a task should have.
COUNTED, BUCKET = 1 << 21, 1 << 22


def _bucket(a: np.ndarray, b: np.ndarray | int, n: int) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def _blob(columns: list[np.ndarray]) -> bytes:
    """Four columns of whole numbers of four bytes, the bytes of equal weight together."""
    flat = b"".join(np.ascontiguousarray(c, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return pa.compress(flat, codec="zstd", asbytes=True)


def _unblob(data: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, 4, n)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view("<i4").reshape(4, n)


def gram_rows(docs: DataFrame, store: Store, frequent: int, buckets: int, how: str = "words", cut: tuple[int, int] = (100, 500)) -> DataFrame:
    """bucket, kind, n and data: what followed contexts, as packed columns; all rows of a context have one bucket.

    Kind 1: the last token, the token and how often, in 31 bits and those above; 0 for the last token is no token, else it is one more than the id.
    Kind 2: two tokens before, the last, the token, the one three before or -1, each time once.
    ``frequent``: tokens of the vocabulary from this id on occur less than ``LEAST`` times, so they are in no list of a
    context of several tokens, and have no rows there.
    """

    def told(bucket: np.ndarray, kind: int, columns: list[np.ndarray]):
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        columns = [c[order] for c in columns]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        full = [i for i in range(buckets) if ends[i] < ends[i + 1]]
        data = [_blob([c[ends[i] : ends[i + 1]] for c in columns]) for i in full]
        sizes = [ends[i + 1] - ends[i] for i in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([kind] * len(full), pa.int32()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "n", "data"])

    def counted(held: list[tuple[np.ndarray, np.ndarray]]):
        ids, pos = (np.concatenate(x) for x in zip(*held))
        one, n = np.unique(ids[ids >= store.size], return_counts=True)  # the others are counted in the vocabulary
        at = np.flatnonzero(pos >= 1)
        pairs, m = np.unique(((ids[at - 1] + 1) << 32) | ids[at], return_counts=True)
        last, token, n = np.r_[np.zeros(len(one), np.int64), pairs >> 32], np.r_[one, pairs & 0xFFFFFFFF], np.r_[n, m]
        yield from told(_bucket(last, 0, buckets), 1, [last, token, n & 0x7FFFFFFF, n >> 31])
        rare = (ids >= frequent) & (ids < store.size)
        at = np.flatnonzero(pos >= 2)
        at = at[~(rare[at] | rare[at - 1] | rare[at - 2])]
        third = np.where((pos[at] >= 3) & ~rare[at - 3], ids[at - 3], -1)
        at, third = (x[np.argsort((ids[at - 1] << 32) | ids[at - 2])] for x in (at, third))
        yield from told(_bucket(ids[at - 1], ids[at - 2] + 1, buckets), 2, [ids[at - 2], ids[at - 1], ids[at], third])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, raw, bounds, _ in bulk.parts(batch, cut):
                for own in _groups(raw, bounds):
                    ids, sizes = coded_ids(*own, store, how)
                    held.append((ids, _places(sizes)))
                    size += len(ids)
                    if size >= COUNTED:
                        yield from counted(held)
                        held, size = [], 0
        if held:
            yield from counted(held)

    return docs.select("text").mapInArrow(run, "bucket int, kind int, n int, data binary")


def vocabulary_rows(vocab: DataFrame, buckets: int) -> DataFrame:
    """The most frequent tokens of a vocabulary as ``gram_rows``: what follows no token at all."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                token, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                at = int(_bucket(np.zeros(1, np.int64), 0, buckets)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), pa.array([1], pa.int32()), pa.array([len(token)], pa.int32()), pa.array([_blob([np.zeros(len(token)), token, n & 0x7FFFFFFF, n >> 31])], pa.binary())], ["bucket", "kind", "n", "data"],
                )

    return vocab.where(F.col("token_id") < CANDIDATES).select("token_id", "n").mapInArrow(run, "bucket int, kind int, n int, data binary")


def _listed(ctx: np.ndarray, token: np.ndarray, n: np.ndarray | None, k: int, least: int) -> pa.RecordBatch:
    """The lists of contexts, from what followed them; ``n``: how often, or else once."""
    order = np.argsort(ctx)
    ctx = ctx[order]
    new = np.r_[True, ctx[1:] != ctx[:-1]] if len(ctx) else np.empty(0, bool)
    keys, both = ctx[new], ((np.cumsum(new) - 1) << 32) | token[order].astype(np.int64)
    if n is None:
        both.sort()
        weight = None
    else:
        again = np.argsort(both)
        both, weight = both[again], n[order][again].astype(np.int64)
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.empty(0, np.int64)
    total = np.diff(np.r_[first, len(both)]) if weight is None else np.add.reduceat(weight, first) if len(first) else first
    both = both[first]
    ctx = keys[both >> 32]
    good = (total >= least) | ((ctx >= 0) & (ctx < 1 << ID_BITS))
    both, ctx, total = both[good], ctx[good], total[good]
    order = np.lexsort((both & 0xFFFFFFFF, -total, both >> 32))
    both, ctx, total = both[order], ctx[order], total[order]
    first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.empty(0, np.int64)
    rank = np.arange(len(ctx)) - np.repeat(first, np.diff(np.r_[first, len(ctx)]))
    keep = rank < k
    columns = [ctx[keep], (both & 0xFFFFFFFF)[keep].astype(np.int32), total[keep], rank[keep].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ctx", "token_id", "n", "rank"])


def rank_table(grams: DataFrame, k: int = CANDIDATES, least: int = LEAST, most: int | None = None, buckets: int = 1) -> DataFrame:
    """ctx, token_id, n and rank (0 to k - 1) from ``gram_rows``: by falling count, then by id.

    Contexts of several tokens list what followed them ``least`` times or more.  If there are over ``most``
    entries, the least frequent go, all of a count alike.
    """
    if not 1 <= k <= CANDIDATES:
        raise ValueError(f"k is from 1 to {CANDIDATES}")

    def lists(held: dict[int, list]):
        for kind in (1, 2):
            if held.get(kind):
                got = np.concatenate([_unblob(data, n) for data, n in held.pop(kind)], axis=1)
                if kind == 1:
                    before = np.maximum(got[0].astype(np.int64) - 1, 0)
                    yield _listed(np.where(got[0] > 0, context_keys([before], [np.ones(len(before), bool)])[1], 0), got[1], got[2] + (got[3].astype(np.int64) << 31), k, least)
                else:
                    there = np.ones(got.shape[1], bool)
                    keys = context_keys([got[1].astype(np.int64), got[0].astype(np.int64), np.maximum(got[3], 0).astype(np.int64)], [there, there, got[3] >= 0])
                    yield _listed(keys[2], got[2], None, k, least)
                    at = np.flatnonzero(got[3] >= 0)
                    yield _listed(keys[3][at], got[2][at], None, k, least)

    def run(batches):
        bucket, held = None, {}
        for batch in batches:
            for own, kind, n, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != bucket:
                    yield from lists(held)
                    bucket, held = own, {}
                held.setdefault(kind, []).append((data, n))
        yield from lists(held)

    ranked = grams.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, "ctx long, token_id int, n long, rank int")
    if most is None:
        return ranked
    ranked = written(ranked)
    step = F.floor(F.log2("n") * 8).cast("int")
    total, lowest = 0, None
    for r in sorted(ranked.groupBy(step.alias("step")).count().collect(), reverse=True):  # some hundred rows, whatever the input
        total += r["count"]
        if total > most:
            break
        lowest = r["step"]
    return ranked if total <= most else ranked.where(step >= (lowest if lowest is not None else 1 << 30))


def next_words(contexts: DataFrame, vocab: DataFrame, ranks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """token, rank and next of the k candidates after each token of ``contexts``."""
    words = vocab.select(F.col("token_id"), F.col("token").alias("next"))
    found = contexts.join(vocab.select("token", (F.col("token_id").cast("long") + 1).alias("ctx")), "token").join(ranks.where(F.col("rank") < k), "ctx")
    return found.join(words, "token_id").select("token", "rank", "next", "n")


def looked(ids: np.ndarray, pos: np.ndarray, store: Store, longest: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """For contexts of 0, 1, ... tokens: the length of each place's list, and the token's rank in it or -1."""
    out = []
    for key in _keys(ids, pos)[: longest + 1]:
        sizes, ranks = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
        at = np.flatnonzero(key != NONE)
        sizes[at], ranks[at] = store.ranks(key[at], ids[at])
        out.append((sizes, ranks))
    return out


def ranked(told: list[tuple[np.ndarray, np.ndarray]], pos: np.ndarray, longest: int, k: int) -> np.ndarray:
    """The rank of each token, -1 where it is no candidate or the first: the longest context that lists it decides."""
    rank, before = np.full(len(pos), -1, np.int64), np.zeros(len(pos), np.int64)
    for sizes, ranks in told[longest::-1]:
        rank = np.where((rank < 0) & (ranks >= 0), before + ranks, rank)
        before += sizes
    return np.where((pos > 0) & (rank < k), rank, -1)


def best(ids: np.ndarray, pos: np.ndarray, store: Store, longest: int, k: int) -> np.ndarray:
    """``ranked`` for one length of contexts: shorter ones are looked up only where longer ones don't list the token."""
    rank, before, todo = np.full(len(pos), -1, np.int64), np.zeros(len(pos), np.int64), np.flatnonzero(pos > 0)
    for key in _keys(ids, pos)[longest::-1]:
        at = todo[key[todo] != NONE]
        sizes, ranks = store.ranks(key[at], ids[at])
        hit = ranks >= 0
        rank[at[hit]] = before[at[hit]] + ranks[hit]
        before[at] += sizes
        todo = todo[(rank[todo] < 0) & (before[todo] < k)]
    return np.where(rank < k, rank, -1)


_KIND_NAMES = pa.array([codec.RANK, codec.EXPLICIT, codec.BREAK])


def _coded(raw: np.ndarray, bounds: np.ndarray, store: Store, how: str, longest: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind (0 a rank, 1 an id) and value of all tokens, and each chunk's number of them."""
    kinds, values, counts = [np.empty(0, np.int8)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for own in _groups(raw, bounds):
        ids, sizes = coded_ids(*own, store, how)
        pos = _places(sizes)
        rank = best(ids, pos, store, longest, k)
        kinds.append((rank < 0).astype(np.int8))
        values.append(np.where(rank >= 0, rank, ids).astype(np.int32))
        counts.append(sizes)
    return np.concatenate(kinds), np.concatenate(values), np.concatenate(counts)


def encode_rows(docs: DataFrame, store: Store, window: int = codec.WINDOW, k: int = CANDIDATES, how: str = "words", cut: tuple[int, int] = (100, 500)) -> DataFrame:
    """doc_id, chunk_no, pos, kind and value: the rank where the token is a candidate, else its id; the first is an id.

    ``docs``: doc_id and text, which is cut into chunks, or doc_id and chunks.
    """
    longest = reach(window)

    def run(batches):
        for batch in batches:
            for part, raw, bounds, counts in bulk.parts(batch, cut):
                kinds, values, sizes = _coded(raw, bounds, store, how, longest, k)
                doc = np.repeat(np.repeat(np.arange(len(counts)), counts), sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(np.repeat(_places(counts), sizes).astype(np.int32)), pa.array(_places(sizes).astype(np.int32)), _KIND_NAMES.take(pa.array(kinds)), pa.array(values)],
                    ["doc_id", "chunk_no", "pos", "kind", "value"],
                )

    kind = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    return docs.select("doc_id", docs.columns[-1]).mapInArrow(run, T.StructType([kind, *T._parse_datatype_string("chunk_no int, pos int, kind string, value int").fields]))


def streams(docs: DataFrame, store: Store, window: int = codec.WINDOW, k: int = CANDIDATES, how: str = "words", cut: tuple[int, int] = (100, 500)) -> DataFrame:
    """doc_id and stream: a document's coded tokens in order, with a break between its chunks; null for no text."""
    longest = reach(window)

    def run(batches):
        for batch in batches:
            for part, raw, bounds, counts in bulk.parts(batch, cut):
                kinds, values, sizes, ends = _with_breaks(*_coded(raw, bounds, store, how, longest, k), counts)
                tokens = pa.StructArray.from_arrays([_KIND_NAMES.take(pa.array(kinds)), pa.array(values)], ["kind", "value"])
                none = part.column(part.num_columns - 1).is_null()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens, mask=none)], ["doc_id", "stream"])

    kind = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([kind, T.StructField("stream", T._parse_datatype_string(f"s array<{codec.TOKEN}>").fields[0].dataType)]))


def _with_breaks(kinds: np.ndarray, values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, values and chunk sizes with a break (kind 2) before each chunk but a document's first; where each document ends."""
    later = (_places(counts) > 0).astype(np.int64)
    at = np.arange(len(kinds)) + np.repeat(np.cumsum(later), sizes)
    wide, more = np.full(len(kinds) + int(later.sum()), 2, np.int8), np.zeros(len(kinds) + int(later.sum()), np.int32)
    wide[at], more[at] = kinds, values
    sizes = sizes + later
    return wide, more, sizes, np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]]


_UNIT = re.compile(rb"z{2,}|[zs]{2}|.")


def body_size(letters: bytes) -> int:
    """Bytes of a coded stream without its header, from a letter for each token: z, s, L of a rank, B, or the bytes of an id."""
    units = _UNIT.findall(letters)
    n = len(units) + letters.count(b"2") + 2 * letters.count(b"3") + 3 * letters.count(b"4")
    if b"z" * (codec.RUN_MOST + 1) in letters:
        n += sum((len(u) - 1) // codec.RUN_MOST for u in units if len(u) > codec.RUN_MOST)
    return n


def body_sizes(docs: DataFrame, store: Store, reaches: Sequence[int], k: int = CANDIDATES, how: str = "words", cut: tuple[int, int] = (100, 500)) -> DataFrame:
    """The columns of ``docs`` but text, reach and body_size: of each stream its size in bytes without the header."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part, raw, bounds, counts in bulk.parts(batch, cut):
                letters: dict[int, list[np.ndarray]] = {r: [np.empty(0, np.uint8)] for r in reaches}
                all_sizes = [np.empty(0, np.int64)]
                for own in _groups(raw, bounds):
                    ids, sizes = coded_ids(*own, store, how)
                    pos = _places(sizes)
                    told = looked(ids, pos, store, max(reaches))
                    width = np.where(ids < codec.EXPLICIT_2, ord("2"), np.where(ids < codec.EXPLICIT_3, ord("3"), ord("4")))
                    for r in reaches:
                        rank = ranked(told, pos, r, k)
                        letters[r].append(np.where(rank < 0, width, np.where(rank == 0, ord("z"), np.where(rank < codec.SMALL, ord("s"), ord("L")))).astype(np.uint8))
                    all_sizes.append(sizes)
                sizes = np.concatenate(all_sizes)
                for r in reaches:
                    flat = np.concatenate(letters[r])
                    kinds, values, _, ends = _with_breaks(np.zeros(len(flat), np.int8), flat.astype(np.int32), sizes, counts)
                    text = np.where(kinds == 2, ord("B"), values).astype(np.uint8).tobytes()
                    made = [body_size(text[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    own = [part.column(i) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(made), r, np.int32)), pa.array(made, pa.int64())], [*names, "reach", "body_size"])

    kinds = [f for f in docs.schema.fields if f.name != "text"]
    return docs.select(*names, "text").mapInArrow(run, T.StructType([*kinds, *T._parse_datatype_string("reach int, body_size long").fields]))


def stream_rows(streams: DataFrame) -> DataFrame:
    """doc_id, chunk_no, pos, kind and value from streams with breaks: the inverse of ``streams``."""
    cut = streams.select("doc_id", F.posexplode(codec.split_breaks(F.col("stream"))).alias("chunk_no", "tokens"))
    return cut.select("doc_id", "chunk_no", F.posexplode("tokens").alias("pos", "t")).select("doc_id", "chunk_no", "pos", "t.kind", "t.value")


#: Fewer ways than these are gone one after the other.
FEW = 48


def walked(is_rank: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: np.ndarray, store: Store, k: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the coded tokens, and which chunks the model can't have made.  Chunks stand in order.

    A rank needs the tokens that its window lets through, so a way ends where that many ids stand between two ranks.
    One rank of all ways at a time; the last few, long ones alone.
    """
    ids, bad = values.astype(np.int64), np.zeros(len(starts), bool)
    at = np.flatnonzero(is_rank)
    if not len(at):
        return ids, bad
    chunk = np.searchsorted(starts, at, "right") - 1
    before = np.minimum(at - starts[chunk], longest[chunk])  # tokens of the longest context
    first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (np.diff(at) > longest[chunk[1:]])])
    count = np.diff(np.r_[first, len(at)])
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    ways = np.searchsorted(-count, -np.arange(int(count[0])), "left").tolist()  # that have so many ranks and one more
    for step, n in enumerate(ways):
        if n < FEW:
            for a, b in zip((first[:n] + step).tolist(), (first[:n] + count[:n]).tolist()):
                _alone(ids, at[a:b], before[a:b], chunk[a:b], bad, store, k)
            break
        own = first[:n] + step
        here = at[own]
        got = _picked(ids, here, before[own], store, k)
        wrong = np.flatnonzero(got < 0)
        if len(wrong):
            bad[chunk[own[wrong]]] = True
            got[wrong] = 0
        ids[here] = got
    return ids, bad


def _picked(ids: np.ndarray, here: np.ndarray, before: np.ndarray, store: Store, k: int) -> np.ndarray:
    """The ids that the ranks at ``here`` stand for, -1 where there is no such candidate; the ids before are known."""
    left, got = ids[here], np.full(len(here), -1, np.int64)
    most = int(before.max())
    keys = context_keys([ids[np.maximum(here - j, 0)] for j in range(1, most + 1)], [before >= j for j in range(1, most + 1)]) if most else [np.zeros(len(here), np.int64)]
    todo = np.flatnonzero((left >= 0) & (left < k))
    for j in range(most, -1, -1):
        t = todo[before[todo] >= j] if j else todo
        if not len(t):
            continue
        listed, found = store.picked(keys[j][t], left[t])
        hit = found >= 0
        got[t] = found
        left[t] -= np.where(hit, 0, listed)
        todo = todo[got[todo] < 0]
    return got


def _alone(ids: np.ndarray, at: np.ndarray, before: np.ndarray, chunk: np.ndarray, bad: np.ndarray, store: Store, k: int) -> None:
    """One way to its end."""
    low = max(int(at[0]) - ORDER, 0)
    own = ids[low : at[-1] + 1].tolist()
    for i, most, c in zip((at - low).tolist(), before.tolist(), chunk.tolist()):
        left, got = own[i], -1
        keys, key = [0], 0
        for j in range(1, most + 1):
            one = own[i - j] + 1
            if one >= 1 << ID_BITS:
                keys = [int(x[0]) for x in context_keys([np.array([own[i - m]]) for m in range(1, most + 1)], [np.ones(1, bool)] * most)]
                break
            key += one << ID_BITS * (j - 1)
            keys.append(key)
        if 0 <= left < k:
            for key in reversed(keys):
                listed = store.list(key)
                if left < len(listed):
                    got = listed[left]
                    break
                left -= len(listed)
        if got < 0:
            bad[c], got = True, 0
        own[i] = got
    ids[at] = np.array(own, np.int64)[at - low]


def spelt(ids: np.ndarray, store: Store) -> list[str]:
    """The words of ids; those above the vocabulary are code points."""
    return _spelt(ids, store).to_pylist()


def _spelt(ids: np.ndarray, store: Store) -> pa.Array:
    own, at = np.unique(ids, return_inverse=True)
    n = int(np.searchsorted(own, store.size))
    words = pa.array([*store.words(own[:n]), *map(chr, (own[n:] - store.size).tolist())], pa.large_string())
    return words.take(pa.array(at))


def _cut(is_break: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and size of each chunk, as ``codec.split_breaks`` cuts: an empty one at the end is dropped."""
    at = np.flatnonzero(is_break)
    doc = np.r_[np.arange(len(ends) - 1), np.searchsorted(ends, at, "right") - 1]
    start = np.r_[ends[:-1], at + 1]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.empty(0, bool)
    stop = np.where(last, ends[doc + 1], np.r_[start[1:] - 1, 0] if len(doc) else start)
    keep = ~(last & (start == stop))
    return doc[keep], start[keep], (stop - start)[keep]


def _decoded(windows: list, kinds: np.ndarray, values: np.ndarray, ends: np.ndarray, store: Store, k: int, faults: list | None = None) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The texts of all chunks, where those of each stream begin (and the end), and the streams' errors; one with an error has no chunks.

    ``kinds``: 0 a rank, 1 an id, 2 a break; ``ends``: where streams begin, and the end.
    """
    n, errors = len(ends) - 1, list(faults) if faults else [None] * (len(ends) - 1)
    doc, start, size = _cut(kinds == 2, ends)
    longest = np.zeros(n, np.int64)
    for i, w in enumerate(windows):
        try:
            longest[i] = reach(w)
        except (ValueError, TypeError) as e:
            errors[i] = errors[i] or f"not of this model: {e}"
    ids, bad = walked(kinds == 0, values, start, size, longest[doc], store, k)
    for i in np.unique(doc[bad]).tolist():
        errors[i] = errors[i] or "not of this model: no such candidate"
    points = ids - store.size
    wrong = np.flatnonzero((ids < 0) | (points > 0x10FFFF) | ((points >= 0xD800) & (points < 0xE000)))
    for i in np.unique(np.searchsorted(ends, wrong, "right") - 1).tolist():
        errors[i] = errors[i] or "not of this model: no such code point"
    good = np.array([e is None for e in errors], bool)
    doc, start, size = (x[good[doc]] for x in (doc, start, size))
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    words = _spelt(ids[at], store)
    _, places, data = words.buffers()
    places = np.frombuffer(places, "<i8")[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(places[np.r_[0, np.cumsum(size)]]), data)
    return texts, np.r_[0, np.cumsum(np.bincount(doc, minlength=n))], pa.array(errors, pa.string())


def _lists(texts: pa.Array, ends: np.ndarray, errors: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), texts.cast(pa.string()), mask=errors.is_valid())


def _joined(texts: pa.Array, ends: np.ndarray, errors: pa.Array) -> pa.Array:
    """The chunks of each stream as one text."""
    whole = _strings(texts, ends)
    return pc.if_else(errors.is_valid(), pa.scalar(None, whole.type), whole) if errors.null_count < len(errors) else whole


def _strings(texts: pa.Array, ends: np.ndarray) -> pa.Array:
    _, places, data = texts.buffers()
    places = np.frombuffer(places, "<i8")[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(places[ends]), data).cast(pa.string())


def _shares(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows of about ``most`` together; ``ends``: where each row's begin, and the end."""
    cuts = np.r_[0, np.flatnonzero(np.diff(ends[1:] // most)) + 1, len(ends) - 1].tolist()
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def decode_streams(rows: DataFrame, store: Store, k: int = CANDIDATES) -> DataFrame:
    """doc_id, chunks (array of text) and error of rows (doc_id, window, stream); error says why chunks is null.

    A chunk's tokens depend on each other, so it is walked place by place, with all other chunks of the batch; nothing is
    shuffled or joined.
    """
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ends = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy().astype(np.int64))]
            for a, b in _shares(ends, 2 * LETTERS):
                own = lists.slice(a, b - a).flatten()
                names, values = own.field("kind"), own.field("value").fill_null(0).to_numpy()
                same = lambda x: pc.equal(names, x).fill_null(False).to_numpy(zero_copy_only=False)
                kinds = np.where(same(codec.RANK), 0, np.where(same(codec.BREAK), 2, 1))
                told = _decoded(batch.column(1).slice(a, b - a).to_pylist(), kinds, values, ends[a : b + 1] - ends[a], store, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(arrow), _lists(*told), told[2]], ["doc_id", "chunks", "error"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("chunks", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])
    return rows.select("doc_id", "window", "stream").mapInArrow(run, schema)


def encode_payloads(docs: DataFrame, store: Store, window: int, k: int = CANDIDATES, how: str = "words", cut: tuple[int, int] = (100, 500)) -> DataFrame:
    """``docs`` (with a column text) and payload: the bytes of each text's stream; null for no text."""
    longest, names = reach(window), [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part, raw, bounds, counts in bulk.parts(batch, cut):
                kinds, values, _, ends = _with_breaks(*_coded(raw, bounds, store, how, longest, k), counts)
                data, at = packed.encode(kinds, values, ends, window)
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
                text = part.column(part.num_columns - 1)
                made = pc.if_else(text.is_null(), pa.scalar(None, pa.binary()), made) if text.null_count else made
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*names, "text", "payload"])

    kinds = [*(docs.schema[c] for c in names), docs.schema["text"], T.StructField("payload", T.BinaryType())]
    return docs.select(*names, "text").mapInArrow(run, T.StructType(kinds))


def decode_payloads(
    rows: DataFrame, store: Store, k: int = CANDIDATES, strict: bool = False, chunks: bool = False, again: tuple[int, str, tuple[int, int]] | None = None,
) -> DataFrame:
    """``rows`` (with a column payload) with back (the text, or its ``chunks``) and back_error, which says why there is none.

    strict: a stream without header, or cut off inside an id, is an error; else it is read as far as it goes.
    ``again``: window, kind of tokens and bounds of chunks, for a column text whose tokens are compared with those read: tokens_identical.
    """
    names = [c for c in rows.columns if c != "payload"]
    longest = reach(again[0]) if again else 0

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            raw, bounds = bulk.raw_bytes(column)
            for a, b in _shares(bounds, SHARE):
                part, own = batch.slice(a, b - a), column.slice(a, b - a)
                windows, kinds, values, ends, faults = packed.decode(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                faults = ["no payload" if none else fault if strict else None for none, fault in zip(own.is_null().to_pylist(), faults)]
                told = _decoded(windows.tolist(), kinds, values, ends, store, k, faults)
                more = [(_lists if chunks else _joined)(*told), told[2]]
                if again:
                    same = np.zeros(b - a, bool)
                    at = 0
                    text = part.select(["text"])
                    for piece, letters, cuts, counts in bulk.parts(text, again[2]):
                        first, second, _, stops = _with_breaks(*_coded(letters, cuts, store, again[1], longest, k), counts)
                        n, low = piece.num_rows, ends[at]
                        off = np.flatnonzero(np.diff(stops) != np.diff(ends[at : at + n + 1])).tolist()
                        if not off and np.array_equal(kinds[low : ends[at + n]], first) and np.array_equal(values[low : ends[at + n]], second):
                            same[at : at + n] = True
                        else:
                            for i in range(n):
                                x, y, u, v = stops[i], stops[i + 1], ends[at + i], ends[at + i + 1]
                                same[at + i] = y - x == v - u and np.array_equal(kinds[u:v], first[x:y]) and np.array_equal(values[u:v], second[x:y])
                        at += n
                    there = own.is_valid().to_numpy(zero_copy_only=False) & part.column("text").is_valid().to_numpy(zero_copy_only=False)
                    more.append(pa.array(same & there))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, "payload", "back", "back_error", *(["tokens_identical"] if again else [])])

    made = T._parse_datatype_string(f"back {'array<string>' if chunks else 'string'}, back_error string" + ", tokens_identical boolean" * bool(again)).fields
    return rows.select(*names, "payload").mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), rows.schema["payload"], *made]))


def both_ways(docs: DataFrame, store: Store, windows: Sequence[int], k: int = CANDIDATES, how: str = "words", cut: tuple[int, int] = (100, 500)) -> DataFrame:
    """The columns of ``docs`` but text, window_size, compressed_size, identical, error, compression_time and decompression_time, for each window.

    Each text is coded to its payload, and the payload decoded and compared with the text, in the task that has the text.  Times are seconds of
    tasks, and a row has its share of them.  What does not depend on the window (chunks, tokens and their ids) is done once and counts for each window;
    windows take turns in being the first, since the first one warms up what the others use.
    """
    names = [c for c in docs.columns if c != "text"]
    reaches = [reach(w) for w in windows]

    def packed_(held, counts, window, longest):
        ranks = [(ids, sizes, best(ids, _places(sizes), store, longest, k)) for ids, sizes in held]
        kinds = np.concatenate([np.empty(0, np.int8), *((r < 0).astype(np.int8) for _, _, r in ranks)])
        values = np.concatenate([np.empty(0, np.int32), *(np.where(r >= 0, r, ids).astype(np.int32) for ids, _, r in ranks)])
        kinds, values, _, ends = _with_breaks(kinds, values, np.concatenate([np.empty(0, np.int64), *(sizes for _, sizes, _ in ranks)]), counts)
        data, at = packed.encode(kinds, values, ends, window)
        return data.tobytes(), at

    def unpacked(data, at):
        texts, errors = [], []
        for a, b in _shares(at, SHARE):
            told = _decoded(*(x.tolist() if i == 0 else x for i, x in enumerate(packed.decode(data[at[a] : at[b]], at[a : b + 1] - at[a])[:4])), store, k)
            texts.append(_joined(*told))
            errors.append(told[2])
        return pa.chunked_array(texts, pa.string()).combine_chunks(), pa.chunked_array(errors, pa.string()).combine_chunks()

    def run(batches):
        turn = 0
        for batch in batches:
            parts = bulk.parts(batch, cut)
            while True:
                began = time.perf_counter()
                got = next(parts, None)
                if got is None:
                    break
                part, raw, bounds, counts = got
                held = [coded_ids(*own, store, how) for own in _groups(raw, bounds)]
                common = time.perf_counter() - began
                text, n = part.column(part.num_columns - 1), part.num_rows
                there = text.is_valid()
                for i in range(len(windows)):
                    w = (i + turn) % len(windows)
                    first = time.perf_counter()
                    data, at = packed_(held, counts, windows[w], reaches[w])
                    second = time.perf_counter()
                    back, errors = unpacked(data, at)
                    third = time.perf_counter()
                    same = pc.fill_null(pc.equal(back, text), False)
                    size = pa.array(np.diff(at), pa.int64(), mask=~there.to_numpy(zero_copy_only=False))
                    errors = pc.if_else(there, errors, "no text")
                    spent = [pa.array(np.full(n, x / n)) for x in (common + second - first, third - second)]
                    own = [part.column(c) for c in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, windows[w], np.int32)), size, same, errors, *spent], [*names, *_BOTH])
                turn += 1

    kinds = [docs.schema[c] for c in names]
    return docs.select(*names, "text").mapInArrow(run, T.StructType([*kinds, *(T.StructField(*x) for x in _BOTH.items())]))


_BOTH = {
    "window_size": T.IntegerType(), "compressed_size": T.LongType(), "identical": T.BooleanType(), "error": T.StringType(),
    "compression_time": T.DoubleType(), "decompression_time": T.DoubleType(),
}


def likeliest(ids: list[int], store: Store, k: int = CANDIDATES) -> list[int]:
    """What may follow ids: the lists of their contexts, the longest first."""
    last = ids[::-1][:ORDER]
    keys = context_keys([np.array([last[j] if j < len(last) else 0]) for j in range(ORDER)], [np.array([j < len(last)]) for j in range(ORDER)])
    out: list[int] = []
    for key in keys[::-1]:
        places = np.arange(CANDIDATES)
        out += [x for x in store.picked(np.repeat(key, CANDIDATES), places)[1].tolist() if x >= 0]
    return out[:k]
