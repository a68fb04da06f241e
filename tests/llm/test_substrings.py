import hashlib
from collections import Counter

import pytest
from near import near_texts

from rankloom.llm import substrings


def brute(docs, size):
    seqs = [(t or "").split() for _, t in docs]
    count = Counter(tuple(w[p : p + size]) for w in seqs for p in range(len(w) - size + 1))
    out = []
    for w in seqs:
        gone = {q for p in range(len(w) - size + 1) if count[tuple(w[p : p + size])] > 1 for q in range(p, p + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed,size,anchor", [(0, 35, 20), (1, 8, 3), (2, 5, 5), (3, 12, 1)])
def test_against_brute_force(spark, seed, size, anchor):
    docs = near_texts(seed) + [(500, "a b " * 60), (501, "x " * 50)]
    rows = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), window=size, anchor=anchor).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept, x.kept_sha256) for x in rows} == {i: v for (i, _), v in zip(docs, brute(docs, size))}


def test_a_passage_of_all_texts_is_spread(spark, monkeypatch):
    """Most rows of a key that every text has don't meet in one partition."""
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    rows = substrings._anchor_rows(substrings._keyed(df, "doc_id", "text"), 35, 20, 4)
    hot = rows.groupBy("anchor").count().orderBy("count", ascending=False).first()["anchor"]
    sizes = [r["count"] for r in rows.where(rows.anchor == hot).groupBy("bucket").count().collect()]
    assert sum(sizes) == 300 and len(sizes) == 4 and max(sizes) < 150
    monkeypatch.setattr(substrings, "MOST_KEYS", 50)
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substrings.dedup(df).collect()}
    assert set(got.values()) == {(63, 60)}


def test_words_that_polynomial_hashes_confuse(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = [(0, " ".join(f"w{k}" for k in range(34)) + " " + one), (1, " ".join(f"w{k}" for k in range(34)) + " " + two)]
    assert [x.n_removed for x in substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == [0, 0]


def test_paths(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    docs = [(0, " ".join(a)), (1, " ".join(b[:9] + a + b[9:])), (2, " ".join(a[:40] + b[:5]))]
    rows = substrings.paths(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((x.doc, x.start, x.length, x.places) for x in rows)
    # 35-word windows of a: the first six are in all three texts, the others in two.
    assert got == [(0, 0, 40, 3), (0, 6, 54, 2), (1, 9, 40, 3), (1, 15, 54, 2), (2, 0, 40, 3)]


def test_edges(edge_docs, no_docs, edge_texts):
    rows = substrings.dedup(edge_docs).collect()
    assert len(rows) == len(edge_texts)
    want = Counter((i, *v) for (i, _), v in zip(edge_texts, brute(edge_texts, 35)))
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept, x.kept_sha256) for x in rows) == want
    assert substrings.dedup(no_docs).count() == 0
