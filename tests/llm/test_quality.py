import binascii

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import quality


def walk(forest, x):
    """One row at a time, one node at a time."""
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
        total += leaf[node - len(feature)]
    return total


def test_trees_learn_and_traverse():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x[:2000], y[:2000], trees=40)
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    np.testing.assert_allclose(forest.raw(x[:50]), [walk(forest, v) for v in x[:50]])


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_one_kind_of_label(y):
    forest = quality.fit(np.zeros((len(y), 3)), np.array(y), trees=3)
    assert forest.score(np.zeros((2, 3)))[0] == pytest.approx((sum(y) + 1) / (len(y) + 2))


def test_statistics_do_not_depend_on_neighbours(edge_texts):
    texts = [t for _, t in edge_texts]
    every = quality.statistics(pa.array(texts, pa.string()))
    assert every.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(every).all()
    for i, t in enumerate(texts):
        np.testing.assert_allclose(quality.statistics(pa.array([t], pa.string()))[0], every[i])
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def test_held_out_and_edges(spark, edge_docs, no_docs, edge_texts):
    labels = spark.createDataFrame([(0, 1), (4, 0), (7, 0), (9, 1), (None, 1), (8, None), (0, 1), (10, 0)], "doc_id long, quality int")
    forest = quality.train(edge_docs, labels)
    rows = quality.score(edge_docs, forest).collect()
    assert len(rows) == len(edge_texts) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in rows)
    assert quality.keep_good(edge_docs, labels).columns == edge_docs.columns
    assert quality.score(no_docs, quality.train(no_docs, labels.limit(0))).count() == 0
    ids = spark.range(200)
    got = {x.id: x.h for x in ids.select("id", quality.held_out(ids.id).alias("h")).collect()}
    assert got == {i: binascii.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


def test_held_out_accuracy(spark):
    from rankloom.llm.frames import table

    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").where(quality.held_out(scored.doc_id)).select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(x.predicted == x.quality for x in rows) / len(rows) > 0.95
