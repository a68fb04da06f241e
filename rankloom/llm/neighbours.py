"""Embedding near-dedup by NN-descent.

Vectors with the same components form one class with a multiplicity; classes are compared.

1. Seeds.  In each of several random-hyperplane trees, rows are sorted by cell and by a
   projection inside the cell, and each is compared with the few rows before it.  Sorting is
   by range, so a large cell is split over tasks.  Rows carry a byte a component: seeds only
   say what to compare first.
2. Descent.  Each round joins neighbours of neighbours: the vectors around a node meet in one
   row, and pairs that are closer than what they have join each other's lists.  A list keeps its
   K best; while links saturate it, it is enlarged to twice the length.  What a list has no
   room for is not lost: the links among the vectors that meet are followed, and those that tie
   two of them together are kept whatever the lists hold.  Rounds go on while they tie
   components together, ``ROUNDS`` at least.
3. Bridges.  Tight groups see only themselves in their lists.  The members of components lie in
   blocks with a centre and a radius; two blocks are compared whole if their centres are near
   enough for any link.  So all links between components of several classes are found.
4. Inside a component all links are counted exactly, in blocks of a bounded size, and no pair
   is written.
5. Audit.  A sample of rows is compared with all rows, in blocks.  It is enlarged until it has
   ``ENOUGH`` links, is the whole table, or is ``LARGEST`` rows; without any link the recall is
   unmeasured, not perfect.  If a link lies in no component, all blocks that could hold a link
   are compared, single rows too: quadratic work at worst, but no pair is written.

All cosines that decide are in double precision.

Nulls: a vector that is null, empty, zero or holds null or non-finite components links with
nothing; vectors of different lengths don't link.  A row without id takes part, and a
component's id is the least id in it.  Equal rows link with each other; equal cosines are
ordered by class.  Other columns are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import Stored, partitions
from .graph import components

THRESHOLD = 0.9
#: Length of a neighbour list, trees, rows compared in a tree, rounds of descent at least, rows that meet in a block.
NEIGHBOURS, TREES, NEAR, ROUNDS, BLOCK = 10, 16, 32, 2, 1024
#: Rows of an audit at first and at most, and the links that it should see.
AUDIT, LARGEST, ENOUGH = 1000, 16_000, 200
#: Rows of a block that are multiplied at a time.
STRIP = 256


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """The rows as unit vectors; None where a row has none."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = None
        if x.is_valid and len(x.values):
            v = np.nan_to_num(x.values.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=np.inf)
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(v).max()
                v = v / top if np.isfinite(top) and top > 0 else None
            if v is not None:
                v = v / np.sqrt((v * v).sum())
        out.append(v)
    return out


def _units(df: DataFrame, id: str, embedding: str) -> DataFrame:
    """id and v: the unit vector's doubles as bytes, null where there is none."""

    def run(batches):
        for batch in batches:
            vs = [None if v is None else (v + 0.0).tobytes() for v in _vectors(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vs, pa.binary())], ["id", "v"])

    return df.select(F.col(id).cast("long").alias("id"), F.col(embedding)).mapInArrow(run, "id long, v binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Byte rows of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _coarse(m: np.ndarray) -> np.ndarray:
    """A byte for each component."""
    top = np.maximum(np.abs(m).max(1, keepdims=True), 1e-300)
    return np.rint(m / top * 127).astype(np.int8)


def _finer(raw: list[bytes]) -> np.ndarray:
    """Unit vectors, about, of what ``_coarse`` has left."""
    m = np.frombuffer(b"".join(raw), dtype=np.int8).reshape(len(raw), -1).astype(np.float32)
    return m / np.sqrt(np.maximum((m * m).sum(1, keepdims=True), 1e-30))


def _seeds(classes: DataFrame, count: int, trees: int, seed: int) -> DataFrame:
    """Directed (a, b, s): the best of the rows near each row in each tree, by cosines that are about right."""
    bits = max(1, int(np.ceil(np.log2(max(2, count / NEAR)))))

    def planes(width: int, tree: int) -> np.ndarray:
        return np.random.default_rng([seed, tree, width]).normal(size=(width, bits + 1))

    def deal(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1).to_pylist()])
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                m = _matrix(own.column(1))
                q = pa.array([x.tobytes() for x in _coarse(m)], pa.binary())
                for tree in range(trees):
                    p = m @ planes(m.shape[1], tree)
                    cell = ((p[:, :bits] > 0) << np.arange(bits)).sum(1).astype(np.int64)
                    arrays = [pa.array(np.full(len(m), tree, np.int32)), pa.array(cell), pa.array(p[:, bits]), own.column(0), q]
                    yield pa.RecordBatch.from_arrays(arrays, ["tree", "cell", "place", "c", "q"])

    def near(batches):
        last: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                rows = last + list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()))
                old, last = len(last), rows[-NEAR:]
                a, b, s = [], [], []
                start = 0
                while start < len(rows):  # rows of one tree and one width
                    end = start
                    while end < len(rows) and rows[end][0] == rows[start][0] and len(rows[end][2]) == len(rows[start][2]):
                        end += 1
                    m = _finer([r[2] for r in rows[start:end]])
                    ids = np.array([r[1] for r in rows[start:end]], dtype=np.int64)
                    for step in range(1, min(NEAR, end - start - 1) + 1):
                        keep = np.arange(step, end - start) + start >= old
                        sims = np.einsum("ij,ij->i", m[step:], m[:-step]).astype(np.float64)
                        a.append(ids[step:][keep])
                        b.append(ids[:-step][keep])
                        s.append(sims[keep])
                    start = end
                if not a:
                    continue
                x, y, z = np.concatenate(a + b), np.concatenate(b + a), np.concatenate(s + s)
                order = np.lexsort((-z, x))
                x, y, z = x[order], y[order], z[order]
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
                good = (rank < 3) | ((z >= THRESHOLD) & (rank < NEIGHBOURS))
                yield pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array(y[good]), pa.array(z[good])], ["a", "b", "s"])

    dealt = classes.select("c", "v").mapInArrow(deal, "tree int, cell long, place double, c long, q binary")
    dealt = dealt.repartitionByRange(partitions(classes.sparkSession), "tree", "cell", "place").sortWithinPartitions("tree", "cell", "place")
    return dealt.select("tree", "c", "q").mapInArrow(near, "a long, b long, s double")


def _best(edges: DataFrame, most: int) -> DataFrame:
    """Each list's best K; of a list whose best K all are links, links up to ``most``."""
    once = edges.where("a <> b").groupBy("a", "b").agg(F.max("s").alias("s"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b")))
    return ranked.where((F.col("rank") <= NEIGHBOURS) | ((F.col("rank") <= most) & (F.col("s") >= THRESHOLD))).drop("rank")


def _ties(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links that are enough to connect all that the links of the square or oblong matrix connect.

    Rows and columns have labels of their own; the least ones spread over the links, and what changes one is a tie.
    """
    rows, columns = near.shape
    low, far = np.arange(rows, dtype=np.int64), np.arange(rows, rows + columns, dtype=np.int64)
    none, out_i, out_j = np.iinfo(np.int64).max, [], []
    while True:
        best = np.where(near, low[:, None], none)
        at, value = best.argmin(0), best.min(0)
        move = np.flatnonzero(value < far)
        out_i.append(at[move])
        out_j.append(move)
        far[move] = value[move]
        best = np.where(near, far[None, :], none)
        at, value = best.argmin(1), best.min(1)
        back = np.flatnonzero(value < low)
        out_i.append(back)
        out_j.append(at[back])
        low[back] = value[back]
        if not len(move) and not len(back):
            return np.concatenate(out_i), np.concatenate(out_j)


def _joined(graph: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Neighbours of neighbours: directed (a, b, s) of rows that meet around a node, the best of each and what ties them together."""

    def run(batches):
        for batch in batches:
            out_a, out_b, out_s = [], [], []
            for cs, vs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                width = len(vs[0])
                keep = [i for i, v in enumerate(vs) if len(v) == width]
                m = np.frombuffer(b"".join(vs[i] for i in keep), dtype=np.float64).reshape(len(keep), -1)
                ids = np.array([cs[i] for i in keep], dtype=np.int64)
                s = m @ m.T
                np.fill_diagonal(s, -2)
                best = np.argsort(-s, axis=1)[:, :4]
                i = np.repeat(np.arange(len(ids)), best.shape[1])
                j = best.ravel()
                good = s[i, j] > -2
                tie_i, tie_j = _ties(s >= THRESHOLD)
                i, j, good = np.r_[i, tie_i], np.r_[j, tie_j], np.r_[good, np.ones(len(tie_i), bool)]
                out_a.append(ids[i[good]])
                out_b.append(ids[j[good]])
                out_s.append(s[i[good], j[good]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_s)], ["a", "b", "s"])

    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("rank") <= most).drop("rank")
    around = graph.select("a", "b").union(back.select("a", "b")).union(classes.select(F.col("c").alias("a"), F.col("c").alias("b"))).distinct()
    met = around.join(classes.select(F.col("c").alias("b"), "v"), "b").groupBy("a").agg(F.collect_list("b").alias("cs"), F.collect_list("v").alias("vs"))
    return met.where(F.size("cs") > 1).select("cs", "vs").mapInArrow(run, "a long, b long, s double")


def _counts(members: DataFrame) -> DataFrame:
    """(c, links): of members (root, c, n, v), the rows of its component within the threshold, itself included."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1) for i in range(batch.num_rows)):
                mine, other = part.column(0).to_pylist()[0], part.column(1).to_pylist()[0]
                if not mine or not other:
                    continue
                links = np.zeros(len(mine), dtype=np.int64)
                for width in {len(x["v"]) for x in mine}:
                    i = [k for k, x in enumerate(mine) if len(x["v"]) == width]
                    j = [k for k, x in enumerate(other) if len(x["v"]) == width]
                    if not j:
                        continue
                    a = np.frombuffer(b"".join(mine[k]["v"] for k in i)).reshape(len(i), -1)
                    b = np.frombuffer(b"".join(other[k]["v"] for k in j)).reshape(len(j), -1)
                    ids_a, ids_b = (np.array([own[k]["c"] for k in at]) for own, at in ((mine, i), (other, j)))
                    n = np.array([other[k]["n"] for k in j])
                    for at in range(0, len(i), STRIP):
                        near = a[at : at + STRIP] @ b.T >= THRESHOLD
                        near |= ids_a[at : at + STRIP, None] == ids_b[None, :]
                        links[i[at : at + STRIP]] = near @ n
                yield pa.RecordBatch.from_arrays([pa.array([x["c"] for x in mine], pa.int64()), pa.array(links)], ["c", "links"])

    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("root", "block", "blocks").agg(F.collect_list(F.struct("c", "n", "v")).alias("rows"))
    one = blocks.select("root", F.col("rows").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    two = blocks.select("root", F.col("block").alias("with"), F.col("rows").alias("other"))
    met = one.join(two, ["root", "with"]).select("mine", "other")
    return met.mapInArrow(run, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


#: A block's centre lies within the angle of ``slack`` of what it stands for, for rounding.
SLACK = 1e-6


def _placed(rooted: DataFrame, count: int) -> DataFrame:
    """Blocks (block, width, rows, centre, radius) of about ``BLOCK`` rows (c, v, root): rows of a component, or of a direction, lie together.

    A component is cut by a projection of its rows; those alone in theirs are put together by the same.
    """

    def deal(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1).to_pylist()])
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                m = _matrix(own.column(1))
                p = m @ np.random.default_rng([5, m.shape[1]]).normal(size=(m.shape[1], 17))
                cell = ((p[:, :16] > 0) << np.arange(16)).sum(1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(m), int(size), np.int32)), pa.array(cell), pa.array(p[:, 16])], ["c", "v", "root", "alone", "width", "cell", "place"])

    dealt = rooted.select("c", "v", "root", "alone").mapInArrow(deal, "c long, v binary, root long, alone boolean, width int, cell long, place double")
    group = F.when(F.col("alone"), F.col("cell")).otherwise(F.col("root"))
    parts = max(1, min(partitions(rooted.sparkSession), -(-count // BLOCK)))
    order = ["width", "alone", "group", "place", "c"]
    lined = dealt.withColumn("group", group).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def block(batches):
        from pyspark import TaskContext

        number, pending, key = TaskContext.get().partitionId() << 32, [], None

        def made(rows):
            m = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.float64).reshape(len(rows), -1)
            centre = m.sum(0)
            size = np.sqrt((centre * centre).sum())
            centre = centre / size if size > 1e-9 else m[0]
            radius = float(np.arccos(np.clip((m @ centre).min(), -1, 1)))
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([m.shape[1]], pa.int32()), pa.array([[{"c": r[0], "root": r[2], "v": r[1]} for r in rows]], ROWS),
                 pa.array([centre.tobytes()], pa.binary()), pa.array([radius])],
                ["block", "width", "rows", "centre", "radius"],
            )

        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in ("c", "v", "root", "alone", "width", "group"))):
                now = (r[4], r[3], None if r[3] else r[5])  # single rows share blocks, components don't
                if pending and (now != key or len(pending) >= BLOCK):
                    yield made(pending)
                    number, pending = number + 1, []
                key = now
                pending.append(r)
        if pending:
            yield made(pending)

    return lined.mapInArrow(block, "block long, width int, rows array<struct<c:bigint,root:bigint,v:binary>>, centre binary, radius double")


ROWS = pa.list_(pa.struct([("c", pa.int64()), ("root", pa.int64()), ("v", pa.binary())]))


def _across(rooted: DataFrame, count: int) -> DataFrame:
    """Of rows (c, v, root, alone): enough linked pairs (a, b) to connect all that is linked across components.

    Two blocks can hold a link only if the angle between their centres is at most their radii and the threshold's angle together.
    """
    angle = math.acos(THRESHOLD) + SLACK

    def pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (batch.column(k)[i].values for k in (0, 1))
                (ba, ca, ra), (bb, cb, rb) = ((x.field(0).to_numpy(), _matrix(x.field(1)), x.field(2).to_numpy()) for x in (one, two))
                for at in range(0, len(ba), STRIP):
                    apart = np.arccos(np.clip(ca[at : at + STRIP] @ cb.T, -1, 1))
                    x, y = np.nonzero((apart <= ra[at : at + STRIP, None] + rb[None, :] + angle) & (ba[at : at + STRIP, None] <= bb[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ba[at + x]), pa.array(bb[y])], ["one", "two"])

    def compared(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (ca, ra, va), (cb, rb, vb) = ((x.field(0).to_numpy(), x.field(1).to_numpy(), _matrix(x.field(2))) for x in (batch.column(k)[i].values for k in (0, 1)))
                out_a, out_b = [ca[:0]], [cb[:0]]
                for at in range(0, len(ca), STRIP):
                    near = (va[at : at + STRIP] @ vb.T >= THRESHOLD) & (ra[at : at + STRIP, None] != rb[None, :])
                    if near.any():
                        x, y = _ties(near)
                        out_a.append(ca[at + x])
                        out_b.append(cb[y])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], ["a", "b"])

    blocks = Stored(_placed(rooted, count)).df
    # The centres themselves are compared in blocks of centres.
    n = blocks.count()
    sets = max(1, -(-n // BLOCK))
    centres = blocks.groupBy("width", F.pmod(F.xxhash64("block"), F.lit(sets)).cast("int").alias("set")).agg(F.collect_list(F.struct("block", "centre", "radius")).alias("rows"))
    one = centres.select("width", F.col("rows").alias("one"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))
    met = one.join(centres.withColumnRenamed("rows", "two"), ["width", "set"]).select("one", "two").mapInArrow(pairs, "one long, two long")
    first = met.join(blocks.select(F.col("block").alias("one"), F.col("rows").alias("rows1")), "one")
    both = first.join(blocks.select(F.col("block").alias("two"), F.col("rows").alias("rows2")), "two")
    return both.select("rows1", "rows2").mapInArrow(compared, "a long, b long").distinct()


@dataclass
class Audit:
    rows: int  # that were compared with all rows
    links: int  # of these rows
    found: int  # those inside a component

    @property
    def recall(self) -> float | None:
        """None where no link was seen: unmeasured."""
        return self.found / self.links if self.links else None


def _sampled(rooted: DataFrame, most: int) -> Audit:
    """rooted: (c, v, root).  The sample is broadcast: at most ``most`` vectors."""
    sample = rooted.select("c", "v", "root").orderBy(F.xxhash64("c", F.lit(17)), "c").limit(most).collect()
    asked = [(r["c"], r["root"], np.frombuffer(r["v"])) for r in sample]
    sent = rooted.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        sets = {}
        for width in {len(v) for _, _, v in sent.value}:
            own = [(c, r, v) for c, r, v in sent.value if len(v) == width]
            sets[width * 8] = (np.array([c for c, _, _ in own]), np.array([r for _, r, _ in own]), np.stack([v for _, _, v in own]))
        links = found = 0
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1).to_pylist()])
            for size in np.unique(sizes):
                if int(size) not in sets:
                    continue
                whole = batch.filter(pa.array(sizes == size))
                c, root, m = sets[int(size)]
                for own in (whole.slice(at, STRIP) for at in range(0, whole.num_rows, STRIP)):
                    near = (m @ _matrix(own.column(1)).T >= THRESHOLD) & (c[:, None] != own.column(0).to_numpy()[None, :])
                    links += int(near.sum())
                    found += int((near & (root[:, None] == own.column(2).to_numpy()[None, :])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([found])], ["links", "found"])

    got = rooted.select("c", "v", "root").mapInArrow(run, "links long, found long").agg(F.sum("links"), F.sum("found")).first()
    return Audit(len(asked), got[0] or 0, got[1] or 0)


def _audited(rooted: DataFrame, count: int) -> Audit:
    """Of as many rows as show ``ENOUGH`` links."""
    most = AUDIT
    while True:
        audit = _sampled(rooted, most)
        if audit.links >= ENOUGH or most >= min(count, LARGEST):
            return audit
        most = min(4 * most, LARGEST)


def near_duplicates(df: DataFrame, id: str = "vec_id", embedding: str = "embedding", audits: list | None = None) -> DataFrame:
    """id, n_links, component_id and kept (is the component's least id) of each row.  ``audits`` gets each Audit."""
    units = Stored(_units(df, id, embedding).withColumn("c", F.when(F.col("v").isNotNull(), F.xxhash64("v")))).df
    classes = Stored(units.where("v is not null").groupBy("c").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least")))
    count = classes.df.count()
    audits = [] if audits is None else audits
    ties = Stored(classes.df.sparkSession.createDataFrame([], "a long, b long"))

    def tied(edges: DataFrame) -> None:
        """Adds the links among edges (a, b, s) to ``ties``, but for those inside its components."""
        nonlocal ties, rooted
        own = edges.where((F.col("s") >= THRESHOLD) & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        side = lambda n: rooted.df.select(F.col("c").alias(n), F.col("root").alias(f"r{n}"))
        fresh = own.join(side("a"), "a").join(side("b"), "b").where("ra <> rb").select("a", "b")
        more = Stored(fresh)
        if not more.df.isEmpty():
            made = Stored(ties.df.union(more.df))
            ties.drop()
            ties = made
            rooted = rooted_by(ties.df)
        more.drop()

    def rooted_by(edges: DataFrame) -> Stored:
        root = components(edges).select(F.col("node").alias("c"), "root")
        return Stored(classes.df.join(root, "c", "left").withColumn("root", F.coalesce("root", "c")))

    def bridged(everything: bool) -> None:
        """Follows what is linked across components: of several classes, or of any."""
        nonlocal ties, rooted
        sizes = rooted.df.groupBy("root").agg((F.count("*") == 1).alias("alone"))
        rows = rooted.df.join(sizes, "root").select("c", "v", "root", "alone")
        more = Stored(_across(rows if everything else rows.where("not alone"), count))
        if not more.df.isEmpty():
            ties = Stored(ties.df.union(more.df))
            rooted = rooted_by(ties.df)

    rooted = rooted_by(ties.df)
    graph = Stored(_best(_seeds(classes.df, count, TREES, 0), NEIGHBOURS))
    turn, most = 0, NEIGHBOURS
    while count:
        met = Stored(_joined(graph.df, classes.df, most))
        before = rooted
        tied(met.df)
        turn += 1
        if turn >= ROUNDS and rooted is before:
            break  # a round that ties nothing together
        # Seeds' cosines are about right only: what met replaces them.
        exact = met.df if turn == 1 else graph.df.union(met.df)
        full = exact.where(F.col("s") >= THRESHOLD).groupBy("a").agg(F.count_distinct("b").alias("n")).where(F.col("n") >= most)
        most = most if full.isEmpty() else 2 * most
        made = Stored(_best(exact, most))
        met.drop()
        graph.drop()
        graph = made
    bridged(False)
    audits.append(_audited(rooted.df, count))
    if audits[-1].found < audits[-1].links:
        bridged(True)
        audits.append(_audited(rooted.df, count))
        if audits[-1].found < audits[-1].links:
            raise RuntimeError(f"links are missing after all blocks were compared: {audits[-1]}")
    several = rooted.df.groupBy("root").agg(F.count("*").alias("size"), F.min("least").alias("component_id"))
    members = rooted.df.join(several.where("size > 1").select("root"), "root").select("root", "c", "n", "v")
    counts = _counts(members)
    by_class = rooted.df.join(several, "root").join(counts, "c", "left").select("c", "component_id", (F.coalesce("links", "n") - 1).alias("n_links"))
    rows = units.select("id", "c").join(by_class, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return rows.select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
