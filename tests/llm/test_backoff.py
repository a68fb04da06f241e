import math
from collections import Counter

import pytest
from near import near_texts

from rankloom.llm import backoff

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, alpha, least):
    docs = [(t or "").translate(LOWER).split() for t in texts]
    one = Counter(w for d in docs for w in d)
    two = Counter(p for d in docs for p in zip(d, d[1:]))
    total = sum(one.values())
    out = []
    for d in docs:
        s = [math.log(one[w] / total) if i == 0 else math.log(two[d[i - 1], w] / one[d[i - 1]]) if two[d[i - 1], w] >= least else math.log(alpha * one[w] / total) for i, w in enumerate(d)]
        out.append(sum(s) / len(s) if s else None)
    return out


@pytest.mark.parametrize("seed,frequent,least", [(0, 1 << 19, 2), (1, 20, 2), (2, 1, 3), (3, 5, 1)])
def test_against_brute_force(spark, seed, frequent, least):
    docs = near_texts(seed, 60)
    got = {x.doc_id: x.score for x in backoff.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least=least, frequent=frequent).collect()}
    for (i, _), want in zip(docs, brute([t for _, t in docs], backoff.ALPHA, least)):
        assert got[i] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_edges(edge_docs, no_docs, edge_texts):
    rows = backoff.score(edge_docs).collect()
    assert len(rows) == len(edge_texts)
    want = brute([t for _, t in edge_texts], backoff.ALPHA, backoff.LEAST)
    for x in rows:
        k = next(k for k, (i, t) in enumerate(edge_texts) if i == x.doc_id)
        assert x.score == (None if want[k] is None else pytest.approx(want[k], abs=1e-9))
    assert backoff.score(no_docs).count() == 0


@pytest.mark.parametrize("bad", [{"least": 0}, {"alpha": 0}, {"frequent": 0}])
def test_bad_parameters(edge_docs, bad):
    with pytest.raises(ValueError):
        backoff.score(edge_docs, **bad)
