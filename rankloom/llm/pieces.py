"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into chunks between bytes that stand side by side in no piece: before spaces, at
line feeds, between most letters and marks.  No piece crosses a cut.  Distinct chunks alone are
encoded:

1. Documents are read in blocks of a bounded size.  A block numbers its distinct chunks, and
   each of its documents becomes a row of numbers.
2. A chunk's substrings up to the longest piece's length are exploded and equi-joined to the
   piece table, which gives the lattice's edges; edges are grouped by chunk.
3. Spark's higher-order ``aggregate`` folds the edges.  For a unigram model this is Viterbi:
   by start, each edge improves the best score at its end.  For a BPE model, whose encoding
   is no best path, edges are folded in the order of their merges: an edge is taken if its
   two ends still are borders and one border is left between them.  Borders of a chunk of up to
   62 characters are the bits of a long, those of a longer one an array; a stretch of over
   ``LONG`` characters without a cut is folded by the same rule in Python.
4. The encodings go back to their blocks by number, and documents are put together there.

Characters without a piece become byte pieces, or the unknown piece where there are none.
Decoding gives the text back exactly, except that the escape character U+2581 itself reads as a
space, as in the library.

Documents and dictionary come from two walks over the same files, partition by partition; an
input that is more than a read of files is written first, so that both walks see the same rows.
A block's dictionary must have a row for each of its numbers, or the query fails.

Nulls: a null or empty text has no pieces.  Equal rows are encoded alike.  Equal scores: the
piece that comes first in the model.  Columns beside id and text are left out, whatever their
names.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import vec
from .frames import settled

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text of a block; characters of a chunk whose borders fit a long, and of one that Spark folds.
BLOCK_BYTES, SHORT, LONG = 16 << 20, 62, 2048
#: Bits of a chunk's number in its block, and of a block's number in its task.
NUMBER_BITS, BLOCK_BITS = 28, 12
#: Places of a chunk that one row holds: those of 2**TASK_BITS tasks.
TASK_BITS = 12
#: Pieces of a model, at most: the table is broadcast.
MOST_PIECES = 1_000_000
SPACE = "▁"


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
    unigram: bool
    unknown: int

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:  # on the driver; executors get what they need in the plan
            m = pb.ModelProto.FromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("only models without normalisation and with a leading space are read")
        if len(m.pieces) > MOST_PIECES:
            raise ValueError(f"a model may have {MOST_PIECES} pieces")
        made = cls([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type == 1, m.trainer_spec.unk_id)
        for p in made.usable():
            inner = p.lstrip(SPACE)
            if SPACE in inner or " " in p:
                raise ValueError(f"piece {p!r} crosses white space")
        return made

    def usable(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (1, 4)}

    def bytes_(self) -> list[int] | None:
        at = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        return [at[f"<0x{b:02X}>"] for b in range(256)] if len(at) == 256 else None

    def order(self) -> dict[str, int]:
        """The place of each piece in the order of merges."""
        use = self.usable()
        return {p: k for k, p in enumerate(sorted(use, key=lambda p: (-self.scores[use[p]], use[p])))}

    def joints(self) -> np.ndarray:
        """[256, 256]: which bytes stand side by side inside a piece.  Between all others a text may be cut.

        Spaces are what they are in a text, and no piece has one after another character.
        """
        out = np.zeros((256, 256), dtype=bool)
        for p in self.usable():
            raw = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            out[raw[:-1], raw[1:]] = True
        lead, tail = np.arange(0x80, 0x100), np.arange(0x80, 0xC0)
        out[np.ix_(lead, tail)] = True  # characters stay whole
        return out

    def longest(self) -> int:
        return max(map(len, self.usable()))


def merged(chunk: str, rank: dict[str, int]) -> list[str]:
    """BPE of one chunk: always the best pair, the leftmost of equals."""
    parts: list[str | None] = list(chunk)
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(rank[p], i, p) for i in range(len(parts) - 1) if (p := chunk[i : i + 2]) in rank]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != p:
            continue
        parts[i], parts[j] = p, None
        right[i] = right[j]
        if right[i] < len(parts):
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < len(parts) and (q := parts[a] + parts[b]) in rank:
                heapq.heappush(heap, (rank[q], a, q))
    return [p for p in parts if p is not None]


def out_of_order(model: Model) -> list[str]:
    """Pieces that the fold in order would miss: those that need a later merge first."""
    rank, bad = model.order(), []
    for p in rank:
        if len(p) > 2:
            borders = set(range(len(p) + 1))
            edges = sorted((rank[q], s, e) for s in range(len(p)) for e in range(s + 2, len(p) + 1) if (q := p[s:e]) in rank)
            for _, s, e in edges:
                inner = [b for b in borders if s < b < e]
                if s in borders and e in borders and len(inner) == 1:
                    borders.remove(inner[0])
            if merged(p, rank) != [p[a:b] for a, b in zip(sorted(borders), sorted(borders)[1:])]:
                bad.append(p)
    return bad


def _blocks(docs: DataFrame, id: str, text: str, dictionary: bool, joints: np.ndarray) -> DataFrame:
    """Rows of chunk numbers, or the numbered chunks: both from the same walk over the partition."""

    id_kind = to_arrow_type(docs.schema[id].dataType)

    def run(batches):
        from pyspark import TaskContext

        task, count, size = TaskContext.get().partitionId(), 0, 0
        known: dict[str, int] = {}
        for batch in batches:
            for part in vec.slices(batch, text):
                if size > BLOCK_BYTES:
                    known, count, size = {}, count + 1, 0
                    if count >> BLOCK_BITS:
                        raise ValueError("a task has too many blocks: spread the texts over more partitions")
                block = (task << BLOCK_BITS) + count
                column = pc.replace_substring(part.column(1).fill_null(""), SPACE, " ")  # the library's escape is a space to it
                column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column, ""))
                data, offsets = vec.flat(column)
                size += len(data)
                edge = np.zeros(len(data) + 1, dtype=bool)
                edge[offsets] = True
                edge[1:-1] |= ~joints[data[:-1], data[1:]] if len(data) else False
                if not len(data):
                    edge[:] = False
                cuts = np.flatnonzero(edge)
                first = np.searchsorted(cuts[:-1], offsets)
                n = max(0, len(cuts) - 1)
                chunks = pa.LargeStringArray.from_buffers(n, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
                told = chunks.dictionary_encode()  # in the order of appearance: numbers of frequent chunks are small
                inverse, unique, old = told.indices.to_numpy(), told.dictionary.to_pylist(), len(known)
                numbers = np.array([known.setdefault(c, len(known)) for c in unique], dtype=np.int64)
                if dictionary:
                    fresh = numbers >= old
                    words = told.dictionary.filter(pa.array(fresh)).cast(pa.string())
                    places = pa.array((block << NUMBER_BITS) + numbers[fresh])
                    for k in range(0, len(words), 1 << 14):
                        yield pa.RecordBatch.from_arrays([words[k : k + (1 << 14)], places[k : k + (1 << 14)]], ["chunk", "place"])
                else:
                    codes = numbers[inverse].astype(np.uint32).view(np.uint8).reshape(-1, 4)
                    blob = pa.compress(np.ascontiguousarray(codes.T).tobytes(), codec="zstd", asbytes=True)  # byte planes: high ones are nearly empty
                    one = pa.array([0, len(part)], pa.int32())
                    counts = pa.array(np.diff(first).astype(np.int32))
                    ids = part.column(0).cast(id_kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.array([len(known)]), pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, counts), pa.array([blob], pa.binary())],
                        ["block", "known", "ids", "counts", "codes"],
                    )

    if dictionary:
        return docs.select(id, text).mapInArrow(run, "chunk string, place long")
    kinds = [("block", T.LongType()), ("known", T.LongType()), ("ids", T.ArrayType(docs.schema[id].dataType)), ("counts", T.ArrayType(T.IntegerType())), ("codes", T.BinaryType())]
    return docs.select(id, text).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds]))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _fold_merges(edges: Column, n: Column) -> Column:
    """The borders (a bit for each) that are left; edges in the order of merges, each a long: order, start, end."""

    def take(b: Column, x: Column) -> Column:
        s, e = _bit(F.shiftright(x, 16).bitwiseAND(63)), _bit(x.bitwiseAND(63))
        inner = b.bitwiseAND(e - s - s)
        good = (b.bitwiseAND(s + e) == s + e) & (inner != 0) & (inner.bitwiseAND(inner - 1) == 0)
        return F.when(good, b - inner).otherwise(b)

    return F.aggregate(edges, _bit(n + 1) - 1, take)


def _fold_merges_long(edges: Column, n: Column) -> Column:
    """The same for any number of borders: an array with the place of each border that is left, -1 elsewhere."""

    def take(b: Column, x: Column) -> Column:
        s, e = F.shiftright(x, 16).bitwiseAND(65535).cast("int"), x.bitwiseAND(65535).cast("int")
        inner = F.filter(F.slice(b, s + 2, e - s - 1), lambda v: v >= 0)
        good = (F.element_at(b, s + 1) >= 0) & (F.element_at(b, e + 1) >= 0) & (F.size(inner) == 1)
        return F.when(good, F.transform(b, lambda v: F.when(v == inner[0], -1).otherwise(v))).otherwise(b)

    return F.filter(F.aggregate(edges, F.sequence(F.lit(0), n), take), lambda v: v >= 0)


def _fold_viterbi(edges: Column, n: Column) -> Column:
    """The borders of the best path; edges (s, e, score) by start.  A character without an edge costs ``score`` of (s, s + 1, null).

    The state is the best score of each border and the border before it; the way back is another fold.
    """
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("v"), F.lit(-1).alias("s"))), F.array_repeat(F.lit(None).cast("struct<v:double,s:int>"), n.cast("int")))

    def take(best: Column, x: Column) -> Column:
        here, there = F.element_at(best, x["s"] + 1), F.element_at(best, x["e"] + 1)
        v = here["v"] + x["score"]
        better = here.isNotNull() & (there.isNull() | (v > there["v"]))
        new = F.struct(v.alias("v"), x["s"].alias("s"))
        return F.when(better, F.transform(best, lambda old, i: F.when(i == x["e"], new).otherwise(old))).otherwise(best)

    def back(path: Column, x: Column) -> Column:  # x: a border and the one before it, from the end
        return F.when(path[0] == x["e"], F.concat(F.array(x["s"]), path)).otherwise(path)

    best = F.aggregate(edges, start, take)
    steps = F.reverse(F.slice(F.transform(best, lambda b, e: F.struct(e.alias("e"), b["s"].alias("s"))), 2, n.cast("int")))
    return F.aggregate(steps, F.array(n.cast("int")), back)


def _borders(chunks: DataFrame, model: Model) -> DataFrame:
    """(chunk, places, b, cuts): of chunks at places, each distinct one with its places and borders, as bits or, over SHORT characters, as places.

    A chunk is one row for each TASKS tasks that read documents, so its places are bounded.  After one shuffle rows
    stay where their chunk is; edges are grouped by a number first, which makes it a radix sort.
    """
    use, rank, longest = model.usable(), model.order(), model.longest()
    rows = [(p, rank[p], model.scores[use[p]]) for p in use if model.unigram or len(p) > 1]
    table = chunks.sparkSession.createDataFrame([*rows, ("", -1, 0.0)], "piece string, o long, score double").withColumn("h", F.xxhash64("piece"))
    keyed = chunks.groupBy("chunk", F.shiftright("place", NUMBER_BITS + BLOCK_BITS + TASK_BITS).alias("set")).agg(F.min("place").alias("key"), F.collect_list("place").alias("places"))
    keyed = keyed.select("chunk", "set", "key", "places", F.translate("chunk", " ", SPACE).alias("text"), F.length("chunk").alias("n"))
    short, least = F.col("n") <= LONG, 1 if model.unigram else 2
    # From each place the substrings up to the longest piece's length; the empty one, which is in the table, keeps every chunk.
    last = F.greatest(F.col("n") - least, F.lit(0))
    spans = keyed.select("chunk", "set", "key", "places", "text", "n", F.explode(F.sequence(F.lit(0), F.when(short, last).otherwise(0))).alias("s"))
    spans = spans.withColumn("places", F.when(F.col("s") == 0, F.col("places")))
    most = F.when(short, F.least(F.lit(longest), F.col("n") - F.col("s"))).otherwise(0)
    lengths = F.concat(F.when(F.col("s") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>")))
    spans = spans.select("chunk", "set", "key", "places", "text", "s", F.explode(lengths).alias("l"))
    places = F.when(F.col("l") == 0, F.col("places")).alias("places")  # with the empty substring only
    spans = spans.select("chunk", "set", "key", places, "s", "l", F.substring("text", F.col("s") + 1, F.col("l")).alias("part"))
    same = (F.xxhash64("part") == F.col("h")) & (F.col("part") == F.col("piece"))
    lattice = spans.join(F.broadcast(table), same)  # MOST_PIECES rows at most
    end = F.col("s") + F.col("l")
    if model.unigram:
        edge = F.struct("s", end.alias("e"), "score")
    else:
        edge = F.shiftleft(F.col("o"), 32) + F.shiftleft(F.col("s").cast("long"), 16) + end
    edges = lattice.groupBy("key", "chunk", "set").agg(F.sort_array(F.collect_list(F.when(F.col("l") > 0, edge))).alias("edges"), F.first("places", ignorenulls=True).alias("places"))
    n = F.length("chunk")
    if model.unigram:
        # A character without piece costs more than any piece, as in the library.
        alone = F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.struct(s.alias("s"), (s + 1).alias("e"), F.lit(float(min(model.scores) - 10)).alias("score")))
        have = F.transform(F.filter("edges", lambda x: x["e"] - x["s"] == 1), lambda x: x["s"])
        path = _fold_viterbi(F.array_sort(F.concat("edges", F.filter(alone, lambda x: ~F.array_contains(have, x["s"])))), n)
        bits, cuts = F.lit(None).cast("long"), F.when(n <= LONG, path)
    else:
        bits = F.when(n <= SHORT, _fold_merges(F.col("edges"), n))
        cuts = F.when((n > SHORT) & (n <= LONG), _fold_merges_long(F.col("edges"), n))
    return edges.select("chunk", "places", bits.alias("b"), cuts.alias("cuts"))


def _spelled(model: Model):
    """A function from a chunk and its borders to its ids; without borders, the same fold in Python: n log n for BPE."""
    use, rank, bytes_ = model.usable(), model.order(), model.bytes_()
    longest, low = model.longest(), min(model.scores) - 10

    def viterbi(text: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-np.inf, 0)] * len(text)
        for s in range(len(text)):
            for e in range(s + 1, min(len(text), s + longest) + 1):
                i = use.get(text[s:e])
                v = best[s][0] + (model.scores[i] if i is not None else low)
                if (i is not None or e == s + 1) and v > best[e][0]:
                    best[e] = (v, s)
        out, e = [], len(text)
        while e:
            out.append(text[best[e][1] : e])
            e = best[e][1]
        return out[::-1]

    def ids(chunk: str, b: int | None, cuts: list[int] | None) -> list[int]:
        text = chunk.replace(" ", SPACE)
        if cuts is not None:
            parts = [text[s:e] for s, e in zip(cuts, cuts[1:])]
        elif b is not None:
            parts, s, b, e = [], 0, b >> 1, 1
            while b:
                if b & 1:
                    parts.append(text[s:e])
                    s = e
                b, e = b >> 1, e + 1
        else:
            parts = viterbi(text) if model.unigram else merged(text, rank)
        return [i for p in parts for i in ((use[p],) if p in use else [bytes_[x] for x in p.encode()] if bytes_ else (model.unknown,))]

    return ids


def _zipped(x: np.ndarray) -> bytes:
    """Numbers as the planes of their bytes, compressed, after their count."""
    planes = np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unzipped(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _packed_ids(rows: DataFrame, model: Model) -> DataFrame:
    """(block, numbers, lengths, ids): a batch's encodings packed for each block; chunks over LONG are folded here."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # MOST_PIECES pieces at most

    def run(batches):
        spell = _spelled(sent.value)
        for batch in batches:
            ids = pa.array([spell(c, b, cuts) for c, b, cuts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))], pa.list_(pa.int32()))
            place = batch.column(1).flatten().to_numpy()
            which = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            block, number = place >> NUMBER_BITS, place & ((1 << NUMBER_BITS) - 1)
            order = np.argsort(block, kind="stable")
            ids = ids.take(pa.array(which[order]))
            flat, size = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
            there, first = np.unique(block[order], return_index=True)
            first = np.r_[first, len(order)]
            at = np.r_[0, np.cumsum(size)][first]
            cut = lambda x, by: pa.array([_zipped(x[a:b]) for a, b in zip(by[:-1], by[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(there), cut(number[order], first), cut(size, first), cut(flat, at)],
                ["block", "numbers", "lengths", "ids"],
            )

    return rows.select("chunk", "places", "b", "cuts").mapInArrow(run, "block long, numbers binary, lengths binary, ids binary")


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", model: Model | None = None, decoded: bool = False) -> DataFrame:
    """id and ids (array of int) of each row; ``decoded``: also text, decoded from the ids in the same task."""
    model = model or Model.load(MODEL)
    if not model.unigram and (bad := out_of_order(model)):
        raise ValueError(f"pieces out of order: {bad[:5]}")
    joints, docs = model.joints(), settled(docs.select(id, text))
    coded, asked = (_blocks(docs, id, text, dictionary, joints) for dictionary in (False, True))
    back = _packed_ids(_borders(asked, model), model)
    docs_id = docs.schema[id].dataType
    arrow_id = to_arrow_type(docs_id)
    kind = T.StructType([T.StructField(id, docs_id), T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("text", T.StringType())] if decoded else [])])
    speller = Speller(model) if decoded else None

    schema = pa.schema([(id, arrow_id), ("ids", pa.list_(pa.int32())), *([("text", pa.string())] if decoded else [])])

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, lengths, flat = (np.concatenate([_unzipped(x) for x in right.column(n).to_pylist()] or [np.empty(0, np.int32)]) for n in ("numbers", "lengths", "ids"))
        size, start = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        size[numbers] = lengths
        start[numbers] = np.cumsum(lengths, dtype=np.int64) - lengths
        known = max(left.column("known").to_pylist(), default=0)
        if len(numbers) != known or len(np.unique(numbers)) != known:
            raise ValueError(f"a block has {known} chunks and {len(numbers)} encodings: the input gave other rows when it was read again")
        out = []
        for i in range(left.num_rows):
            counts = left.column("counts")[i].values.to_numpy()
            n = int(counts.sum())
            planes = np.frombuffer(pa.decompress(left.column("codes")[i].as_py(), decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
            codes = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
            own = size[codes]
            total = np.r_[0, np.cumsum(own)]
            ids = flat[np.repeat(start[codes] - total[:-1], own) + np.arange(total[-1])]
            offsets = total[np.r_[0, np.cumsum(counts)]].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            out.append(pa.RecordBatch.from_arrays([left.column("ids")[i].values, lists, *([speller.texts(lists)] if speller else [])], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return coded.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(together, kind)


class Speller:
    """Texts from ids, without a Python step for each id."""

    def __init__(self, model: Model):
        bytes_ = {i: b for b, i in enumerate(model.bytes_() or [])}
        kinds = zip(model.pieces, model.kinds)
        spelled = [bytes([bytes_[i]]) if i in bytes_ else b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(kinds)]
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(x) for x in spelled], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def texts(self, lists: pa.ListArray) -> pa.Array:
        flat = lists.flatten().to_numpy()
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        own = self.length[flat]
        total = np.r_[0, np.cumsum(own)]
        raw = self.data[np.repeat(self.start[flat] - total[:-1], own) + np.arange(total[-1])].tobytes()
        ends = total[np.r_[0, np.cumsum(size)]].tolist()
        texts = (raw[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:]))
        return pa.array([t[1:] if t[:1] == " " else t for t in texts], pa.string())


def decode(rows: DataFrame, ids: str = "ids", model: Model | None = None) -> DataFrame:
    """``rows`` with text, from their ids."""
    speller = Speller(model or Model.load(MODEL))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([*part.columns, speller.texts(part.column(names.index(ids)))], [*names, "text"])

    return rows.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the ids, joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)

