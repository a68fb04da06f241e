import random

import numpy as np
import pytest

from rankloom.llm import neighbours


def brute(rows):
    vs = {}
    for k, (_, e) in enumerate(rows):
        if e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, dtype=np.float64)
            vs[k] = v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())
    links = {k: {j for j in vs if j != k and len(vs[j]) == len(vs[k]) and vs[j] @ vs[k] >= 0.9} if k in vs else set() for k in range(len(rows))}
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((len(links[k]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("seed,block", [(0, 1024), (1, 16)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, 24))
    rows = []
    for i in range(400):
        c = centres[r.integers(8)] if r.random() < 0.5 else r.normal(size=24)
        rows.append((i, (c + r.normal(size=24) * r.choice((0, 0.05, 0.2, 0.3))).astype(np.float32).tolist()))
    audits = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id) for x in neighbours.near_duplicates(df, audits=audits).collect()}
    assert got == {i: v for (i, _), v in zip(rows, brute(rows))}
    assert len(audits) == 1 and audits[0].recall == 1 and audits[0].links > 0


@pytest.mark.parametrize("size,count", [(0.004, 240), (0.03, 500)])
def test_links_between_two_tight_groups(spark, monkeypatch, size, count):
    """Each group fills all lists with its own members; some or all of them link across."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    r = np.random.default_rng(3)
    one, turn = np.zeros(24), np.zeros(24)
    one[0], turn[1] = 1, 1
    cosine = 0.93 if count == 240 else 0.893
    two = cosine * one + np.sqrt(1 - cosine**2) * turn
    rows = [(i, ((one, two)[i % 2] + r.normal(size=24) * size).tolist()) for i in range(count)]
    audits = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id) for x in neighbours.near_duplicates(df, audits=audits).collect()}
    assert got == {i: v for (i, _), v in zip(rows, brute(rows))} and got[count - 1][1] == 0
    assert [a.recall for a in audits] == [1]


def test_a_failed_audit_compares_all_blocks_or_raises(spark, monkeypatch):
    """The descent finds nothing; the audit sees that."""
    monkeypatch.setattr(neighbours, "_joined", lambda graph, classes, most: graph.limit(0))
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + r.normal(size=16) * 0.05).tolist()) for i in range(90)]
    df, audits = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), []
    got = {x.vec_id: (x.n_links, x.component_id) for x in neighbours.near_duplicates(df, audits=audits).collect()}
    assert got == {i: v for (i, _), v in zip(rows, brute(rows))} and [a.recall for a in audits] == [0, 1]
    monkeypatch.setattr(neighbours, "_across", lambda rooted, count: rooted.select(rooted.c.alias("a"), rooted.c.alias("b")).limit(0))
    with pytest.raises(RuntimeError):
        neighbours.near_duplicates(df)
    alone, audits = spark.createDataFrame(rows[:30], "vec_id long, embedding array<double>"), []
    assert neighbours.near_duplicates(alone, audits=audits).count() == 30 and audits[0].recall is None and audits[0].rows == 30


def test_ties_connect_what_links_connect():
    r = np.random.default_rng(1)
    for _ in range(40):
        near = r.random((r.integers(1, 12), r.integers(1, 12))) < 0.15
        root = {x: x for x in range(sum(near.shape))}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        def parts(pairs):
            root.update({x: x for x in root})
            for i, j in pairs:
                root[find(i)] = find(near.shape[0] + j)
            return {frozenset(y for y in root if find(y) == find(x)) for x in root}

        assert parts(zip(*np.nonzero(near))) == parts(zip(*neighbours._ties(near)))


def test_edges(spark):
    r = random.Random(0)
    v = [r.random() for _ in range(8)]
    rows = [(0, v), (1, v), (1, v), (2, [x * 3 for x in v]), (3, None), (4, []), (5, [0.0] * 8), (6, [None] + v[1:]), (7, [float("nan")] + v[1:]), (8, [float("inf")] + v[1:]), (9, v[:4]), (None, v), (10, [1e-300 * x for x in v])]
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], "vec_id long, embedding array<double>, c string, root string")
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in neighbours.near_duplicates(df).collect()), key=str)
    want = sorted(((i, n, c if c is not None else None, i is not None and i == c) for (i, _), (n, c) in zip(rows, brute(rows))), key=str)
    assert got == want
    assert neighbours.near_duplicates(df.limit(0)).count() == 0
