"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes of its distinct word shingles.  Documents with equal sets
form one class; classes are compared, never their copies.

1. Every shingle of every class goes once through a shuffle, packed into arrays for each
   hash bucket, and is counted there (its document frequency).  A task sends a class once;
   what tasks send of one class falls together where it is counted, before it is gathered.
2. Shingles of one class only can't be shared.  A class whose unshared shingles outnumber
   the differences that the threshold allows has no partner.
3. The shared shingles of the others are ordered by frequency, rarest first.  Rare shingles
   are indexed alone, frequent ones as pairs, very frequent ones as triples within hash
   groups.  A combination of k needs k shared shingles in a group, so the prefix is
   extended until the shingles that it can lose outnumber the differences allowed: any two
   linked classes then share a signature.  Groups grow with the size of the set, and a
   set near the border of two size levels is indexed in both, so combinations stay few.
4. Classes that share a signature are verified exactly, in rounds: each class with one
   partner, then with the first of each of its signatures.  Signatures whose classes still
   are in several components tie their classes into clusters, and a cluster's sets are
   multiplied in blocks of a bounded size: pairs inside it never become rows.

Nulls and empty texts: an empty set, linked with nothing.  Rows without id take part; a
component's id is the least id in it.  Equal rows and copies share a class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import vec
from .frames import Stored, add_columns, field, packed, partitions, unpacked
from .graph import components

#: Documents link when 100 * intersection >= PERCENT * union.
PERCENT = 85
SHINGLE = 4
#: A shingle of at most RARE classes is indexed alone, of at most FREQUENT in pairs, else in triples.
RARE, FREQUENT = 16, 256
#: Sets below LEVEL are indexed by single shingles only; each further level doubles, and so do its groups.
LEVEL, GROUPS = 80, 16
#: Classes that a task remembers to have sent, at most; beyond, it starts anew and may send some again.
MOST_COPIES = 2_000_000


class Sets:
    """The distinct shingles of each row of a slice, ordered by row and hash."""

    def __init__(self, column: pa.Array, size: int):
        w = vec.words_of(column, lower=True)
        n = np.diff(w.first)
        grams = vec.gram_hashes(w.hashes, size)
        rows = w.row_of()
        whole = np.flatnonzero((n > 0) & (n < size))
        ends = w.first[1:]
        inside = np.arange(len(grams)) + size <= ends[rows[: len(grams)]]
        hashes = np.r_[grams[inside], vec.sequence_hash(w.hashes, w.first)[whole]]
        rows = np.r_[rows[: len(grams)][inside], whole]
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])] if len(rows) else np.zeros(0, bool)
        self.hashes, self.rows = hashes[fresh], rows[fresh]
        self.first = np.searchsorted(self.rows, np.arange(len(n) + 1))
        self.sizes = np.diff(self.first)
        self.key = vec.sequence_hash(self.hashes, self.first).view(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)


def _pair(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return vec.mix(key.view(np.uint64) ^ vec.mix(ids.view(np.uint64))).view(np.int64)


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row (all by default), n_shingles, class (a hash of the set; null if it is empty) and copy (of class and id)."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            s = Sets(part.column(part.schema.get_field_index(text)), size)
            ids = _ids(part.column(part.schema.get_field_index(id)))
            return [s.sizes, pa.array(s.key, mask=s.sizes == 0), _pair(s.key, ids)]

        return work

    fields = [field("n_shingles", T.LongType()), field("class", T.LongType()), field("copy", T.LongType())]
    return add_columns(docs, make, fields, text, keep=keep)


def _instances(docs: DataFrame, text: str, size: int, parts: int) -> DataFrame:
    """(bucket, shingle, class, size): arrays of equal length for each slice of rows and hash bucket."""
    most = MOST_COPIES

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for part in vec.slices(batch, text):
                s = Sets(part.column(part.schema.get_field_index(text)), size)
                fresh = np.zeros(len(s.key), bool)
                for i in np.unique(s.key, return_index=True)[1].tolist():
                    key = int(s.key[i])
                    if key not in sent:
                        if len(sent) >= most:
                            sent.clear()
                        sent.add(key)
                        fresh[i] = True
                mask = fresh[s.rows]
                rows, hashes = s.rows[mask], s.hashes[mask]
                columns = [hashes.view(np.int64), s.key[rows], s.sizes[rows].astype(np.int32)]
                yield from packed(hashes, parts, ["shingle", "class", "size"], columns)

    return docs.select(text).mapInArrow(run, "bucket int, shingle array<long>, class array<long>, size array<int>")


def allowed(size: int, percent: int = PERCENT) -> int:
    """How many elements of a set of this size a partner may lack."""
    return size - -(-percent * size // 100)


def _signatures(size: int, shingles: np.ndarray, frequency: np.ndarray, percent: int) -> set[int]:
    """Signatures of a set: the prefix's shingles alone or combined.  shingles: the shared ones, rarest first."""
    need = allowed(size, percent) + 1 - (size - len(shingles))
    base = LEVEL * 100 // percent
    if need <= 0:
        return set()
    modes = [-1] if size < base else []
    level = 0
    while LEVEL << level <= size * 100 // percent + 1:
        if size * 100 >= (LEVEL << level) * percent and size < (base << (level + 1)):
            modes.append(level)
        level += 1
    out: set[int] = set()
    for mode in modes:
        kinds = np.ones(len(shingles), dtype=np.int64) if mode < 0 else 1 + (frequency > RARE) + (frequency > FREQUENT)
        group = (shingles.view(np.uint64) % np.uint64(GROUPS << max(mode, 0))).astype(np.int64)
        own: dict[tuple[int, int], list[int]] = {}
        credit = 0
        for kind, g, x in zip(kinds.tolist(), group.tolist(), shingles.tolist()):
            place = own.setdefault((kind, g if kind > 1 else 0), [])
            place.append(x)
            credit += len(place) >= kind
            if credit >= need:
                break
        for (kind, _), members in own.items():
            for c in combinations(sorted(members), kind):
                out.add(hash((mode, kind, *c)))
    return out


def _candidates(shared: DataFrame, percent: int) -> DataFrame:
    """(class, size, shingles) and signatures of the classes that may have a partner."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                ends = part.column(2).offsets.to_numpy()
                pairs = part.column(2).flatten()
                every, counts = (pairs.field(i).to_numpy() for i in (0, 1))
                ends = ends - ends[0]
                sets, signs = [], []
                for i, n in enumerate(part.column(1).to_pylist()):
                    x, y = every[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]
                    order = np.lexsort((x, y))
                    sets.append(np.sort(x))
                    signs.append(sorted(_signatures(n, x[order], y[order], percent)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))],
                    ["class", "size", "shingles", "signatures"],
                )

    return shared.mapInArrow(run, "class long, size int, shingles array<long>, signatures array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("shingles").alias("xa"))
    two = sets.select(F.col("class").alias("b"), F.col("size").alias("nb"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    found = pairs.join(one, "a").join(two, "b").withColumn("i", both)
    return found.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def links(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows with n_shingles and class, edges (a, b) between classes): enough edges that all linked classes are connected."""
    parts = partitions(docs.sparkSession)
    own = Stored(classes(docs, id, text, size, keep=[id])).df
    return own, _edges(_instances(docs, text, size, parts), parts, percent)


def _edges(instances: DataFrame, parts: int, percent: int) -> DataFrame:
    key = Window.partitionBy("shingle", "bucket")
    rows = unpacked(instances, parts, ["shingle", "class", "size"])
    rows = rows.withColumn("least", F.min("class").over(key)).withColumn("most", F.max("class").over(key)).where("least <> most")
    # Several tasks may have sent a class: once is enough.  The rows of a bucket are in one partition already.
    rows = rows.select("bucket", "shingle", "class", "size").distinct().withColumn("frequency", F.count("*").over(key))
    shared = rows.groupBy("class", "size").agg(F.collect_list(F.struct("shingle", "frequency")).alias("shared"))
    # The allowed differences, as in allowed(); most classes have more shingles of their own and end here.
    open_to = F.col("size") - F.size("shared") <= F.floor(F.col("size") * (100 - percent) / 100)
    found = Stored(_candidates(shared.where(open_to), percent))
    sets = found.df.select("class", "size", "shingles")
    signed = found.df.select("class", "size", F.explode("signatures").alias("signature"))
    fits = lambda a, b: (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))
    first = signed.groupBy("signature").agg(F.count("*").alias("n"), F.min(F.struct(F.col("class").alias("a"), F.col("size").alias("na"))).alias("p"))
    index = Stored(signed.join(first.where("n > 1"), "signature").select("signature", "n", "class", "size", "p.a", "p.na"))
    star = index.df.where(F.col("a") != F.col("class")).where(fits("na", "size"))
    round1 = Stored(_verified(star.groupBy(F.col("class").alias("b")).agg(F.min("a").alias("a")), sets, percent))
    root = components(round1.df)

    def rooted(df: DataFrame, node: str, name: str) -> DataFrame:
        r = root.select(F.col("node").alias(node), F.col("root").alias(name))
        return df.join(r, node, "left").withColumn(name, F.coalesce(name, node))

    pairs = star.select("a", F.col("class").alias("b")).distinct()
    apart = rooted(rooted(pairs, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    round2 = Stored(_verified(apart, sets, percent))
    root = components(round1.df.union(round2.df))
    # What is left: signatures whose classes are in several components.  Classes that such signatures tie together
    # form a cluster, and its pairs across components are verified in blocks.
    open_ = rooted(index.df.where(F.col("class") != F.col("a")).select("signature", "class"), "class", "r")
    mixed = open_.groupBy("signature").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.min("class").alias("a")).where("lo <> hi").select("signature", "a")
    ties = Stored(open_.select("signature", "class").join(mixed, "signature").select("a", F.col("class").alias("b")).distinct())
    cluster = components(ties.df).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    held = ties.df.select(F.col("b").alias("class")).distinct().join(cluster, "class", "left").withColumn("cluster", F.coalesce("cluster", "class"))
    round3 = Stored(_within(rooted(held, "class", "r"), sets, percent))
    return round1.df.union(round2.df).union(round3.df)


#: Size of a block, about: each set counts its shingles and ``ROW`` more, so a block has 2,048 sets at most, give or take.
BLOCK, ROW = 1 << 19, 256
#: Columns of a block's matrix, and rows of what is made from it, at a time.
WIDTH, TILE = 1024, 256


def _tiles(n: int) -> list[slice]:
    return [slice(at, at + TILE) for at in range(0, n, TILE)]


def _lowest(linked: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the column with the least label that it is linked with, and that label (the largest long without links)."""
    at, low = np.empty(len(linked), np.int64), np.empty(len(linked), np.int64)
    for t in _tiles(len(linked)):
        x = np.where(linked[t], labels, np.iinfo(np.int64).max)
        at[t], low[t] = x.argmin(1), x.min(1)
    return at, low


def _within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of clusters (cluster, class, r) of sets (class, size, shingles): enough linked pairs (a, b) to connect what is linked across components r.

    A cluster is dealt into blocks of a bounded size, and each two blocks meet in one row: intersections are products
    of 0/1 matrices, and no pair becomes a row unless it joins two components.  Sets are shuffled by class and by
    block, never by cluster: one cluster may hold most of them.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (batch.column(c)[i].values for c in (0, 1))
                (ca, ra, na, xa), (cb, rb, nb, xb) = (_columns(x) for x in (one, two))
                linked = _products(na, xa, nb, xb)
                for t in _tiles(len(ca)):
                    both = linked[t].astype(np.int64)
                    linked[t] = (100 * both >= percent * (na[t, None] + nb - both)) & (ra[t, None] != rb)
                linked = linked.astype(bool)
                out_a, out_b = [], []
                labels_a, labels_b = ra.copy(), rb.copy()
                while True:  # least labels spread over the links; what changes a label is an edge
                    at, low = _lowest(linked, labels_b)
                    move = np.flatnonzero(low < labels_a)
                    out_a.append(ca[move])
                    out_b.append(cb[at[move]])
                    labels_a[move] = low[move]
                    at, low = _lowest(linked.T, labels_a)
                    back = np.flatnonzero(low < labels_b)
                    out_a.append(ca[at[back]])
                    out_b.append(cb[back])
                    labels_b[back] = low[back]
                    if not len(move) and not len(back):
                        break
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    sized = members.join(sets.select("class", "size"), "class")
    sizes = sized.groupBy("cluster").agg(F.count("*").alias("count"), F.ceil(F.sum(F.col("size") + ROW) / BLOCK).cast("int").alias("blocks"))
    placed = sized.join(sizes.where("count > 1"), "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    full = placed.select("class", "r", "cluster", "block", "blocks").join(sets, "class")
    blocks = Stored(full.groupBy("cluster", "block", "blocks").agg(F.collect_list(F.struct("class", "r", "size", "shingles")).alias("rows"))).df
    one = blocks.select("cluster", F.col("rows").alias("one"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("with"))
    two = blocks.select("cluster", F.col("block").alias("with"), F.col("rows").alias("two"))
    return one.join(two, ["cluster", "with"]).select("one", "two").mapInArrow(run, "a long, b long").distinct()


def _columns(rows: pa.StructArray) -> tuple:
    c, r, n = (rows.field(i).to_numpy() for i in range(3))
    return c, r, n.astype(np.int64), rows.field(3)


def _products(na: np.ndarray, xa: pa.ListArray, nb: np.ndarray, xb: pa.ListArray) -> np.ndarray:
    """Sizes of all intersections of the sets xa with the sets xb."""
    values = [x.flatten().to_numpy() for x in (xa, xb)]
    common = np.intersect1d(*map(np.unique, values))
    out = np.zeros((len(xa), len(xb)), np.int32)
    if not len(common):
        return out
    sides = []
    for x, v in zip((xa, xb), values):
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        inside = np.flatnonzero(common[at] == v)
        inside = inside[np.argsort(at[inside], kind="stable")]
        sides.append((len(x), at[inside], np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))[inside]))
    for first in range(0, len(common), WIDTH):
        two = []
        for n, at, rows in sides:
            lo, hi = np.searchsorted(at, [first, first + WIDTH])
            m = np.zeros((n, min(WIDTH, len(common) - first)), np.float32)
            m[rows[lo:hi], at[lo:hi] - first] = 1
            two.append(m)
        for t in _tiles(len(xa)):
            out[t] += (two[0][t] @ two[1].T).astype(np.int32)
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links) of each row."""
    own, edges = links(docs, id, text, size, percent)
    root = components(edges).select(F.col("node").alias("class"), "root")
    least = own.where("class is not null").groupBy("class").agg(F.min(id).alias("least"))
    rooted = least.join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(best, "root").select("class", "component_id")
    return own.join(by_class, "class", "left").select(id, "n_shingles", F.coalesce("component_id", F.col(id)).alias("component_id"))


#: For the corpus: words a shingle, and the similarity of near duplicates in hundredths.
CORPUS_SHINGLE, CORPUS_PERCENT = 5, 80


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = CORPUS_SHINGLE, percent: int = CORPUS_PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document, that of the least id, of each group of near duplicates.

    Rows equal in id and text are one document.  Rows without words all stay.
    """
    own, edges = links(docs, id, text, size, percent)
    root = components(edges).select(F.col("node").alias("class"), "root")
    members = own.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"))).alias("least"))
    rooted = members.join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))
    best = rooted.groupBy("root").agg(F.min(F.struct("least", F.col("class").alias("best"))).alias("b")).select("root", "b.best", F.col("b.least.id").alias("least"))
    placed = own.join(rooted.select("class", "root"), "class").join(best, "root")
    gone = placed.where((F.col("class") != F.col("best")) | ~F.col(id).eqNullSafe(F.col("least"))).select(F.col("copy").alias("_copy"))
    twice = own.where("class is not null").groupBy("copy").count().where("count > 1").select(F.col("copy").alias("_copy"))
    spare = {c: f"_kept_{c}" for c in docs.columns if c in ("n_shingles", "class", "copy")}
    tagged = classes(docs.withColumnsRenamed(spare), spare.get(id, id), spare.get(text, text), size, keep=None)
    kept = tagged.join(Stored(gone.distinct()).df, F.col("copy") == F.col("_copy"), "left_anti")
    repeated = Stored(twice).df
    if not repeated.isEmpty():
        same = F.col("copy") == F.col("_copy")
        kept = kept.join(repeated, same, "left_anti").union(kept.where("class is not null").join(repeated, same, "left_semi").dropDuplicates(["copy"]))
    return kept.select(*[F.col(spare.get(c, c)).alias(c) for c in docs.columns])
