import pytest
from near import near_texts

from rankloom.llm import jaccard


def classes(docs, percent, size):
    """Set sizes and least linked ids, by comparing every two sets."""
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed,rare,frequent,block", [(0, 16, 256, 1 << 19), (1, 1, 2, 500), (2, 2, 5, 500), (3, 16, 256, 500)])
def test_against_brute_force(spark, monkeypatch, seed, rare, frequent, block):
    for k, v in (("RARE", rare), ("FREQUENT", frequent), ("BLOCK", block), ("WIDTH", 64), ("TILE", 3)):
        monkeypatch.setattr(jaccard, k, v)
    docs = near_texts(seed)
    rows = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == classes(docs, 85, 4)


def test_copies_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_COPIES", 1)
    docs = near_texts(6, 60)
    rows = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == classes(docs, 85, 4)


@pytest.mark.parametrize("most", [1, 2_000_000])
def test_copies_are_gathered_once(spark, monkeypatch, most):
    """However many copies a class has, and whatever a task remembers, its shingles are gathered once."""
    monkeypatch.setattr(jaccard, "MOST_COPIES", most)
    seen, candidates = [], jaccard._candidates

    def watched(shared, percent):
        seen.append(shared.selectExpr("max(size(shared) - size)", "count(*)").first())
        return candidates(shared, percent)

    monkeypatch.setattr(jaccard, "_candidates", watched)
    base = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(base)) for i in range(50)] + [(50, " ".join(base[:-1]))] + [(60 + i, f"a b c d e f g {i % 2}") for i in range(20)]
    rows = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == classes(docs, 85, 4)
    assert seen[0][0] <= 0 and seen[0][1] == 2


def test_linked_sets_share_a_signature():
    import random

    import numpy as np

    r = random.Random(4)
    for _ in range(300):
        n = r.choice((5, 60, 79, 80, 94, 95, 150, 300, 700))
        x = list(range(1000, 1000 + n))
        y = list(x)
        for _ in range(r.randint(0, n // 8)):
            if r.random() < 0.5 and len(y) > 1:
                y.remove(r.choice(y))
            else:
                y.append(r.randint(5000, 9000))
        y = sorted(set(y))
        if 100 * len(set(x) & set(y)) < 85 * len(set(x) | set(y)):
            continue
        often = {k: r.choice((2, 20, 500)) for k in set(x) | set(y)}
        signs = []
        for s in (x, y):
            keys = np.array(s, dtype=np.int64) * 2654435761
            counts = np.array([often[k] for k in s])
            order = np.lexsort((keys, counts))
            signs.append(jaccard._signatures(len(s), keys[order], counts[order], 85))
        assert signs[0] & signs[1]


def test_edges(edge_docs, no_docs, edge_texts):
    rows = jaccard.near_duplicates(edge_docs).collect()
    assert len(rows) == len(edge_texts)
    by = {x.doc_id: x for x in rows}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[5].component_id == 0 and by[9].component_id == 0 and by[None].component_id == 0
    kept = jaccard.representatives(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 10]
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.representatives(no_docs).count() == 0


def test_one_of_each_group_stays(spark):
    docs = near_texts(8)
    docs += docs[:5]  # repeated rows
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = classes(docs, 80, 5)
    want = sorted(i for i, (n, root) in found.items() if i == root)
    empty = sorted(i for i, t in docs if not (t or "").split())
    got = sorted(x.doc_id for x in jaccard.representatives(df).collect())
    assert got == sorted([i for i in want if found[i][0]] + empty)
