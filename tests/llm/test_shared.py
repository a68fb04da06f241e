import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankloom.llm import frames, graph, queries, vec


def test_words_and_hashes():
    texts = ["a b c", None, "", "  hello\tworld é ", "a b c", "world", "\x0b\x0c", "x"]
    w = vec.words_of(pa.array(texts))
    found = [[w.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert found == [(t or "").split() for t in texts]
    assert w.hashes[0] == w.hashes[6] and w.hashes[4] == w.hashes[9]
    alone = vec.words_of(pa.array(["world"]))
    assert alone.hashes[0] == w.hashes[4]
    r = random.Random(0)
    words = [r.choice("abcd") for _ in range(300)]
    g = vec.gram_hashes(vec.words_of(pa.array([" ".join(words)])).hashes, 5)
    grams = [tuple(words[i : i + 5]) for i in range(296)]
    assert len(set(g.tolist())) == len(set(grams)) and all((g[i] == g[j]) == (grams[i] == grams[j]) for i in range(0, 296, 7) for j in range(296))


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 900, 3, 3, 0)] + [None])], ["t"])
    parts = list(vec.slices(batch, "t", 10))
    assert sum(p.num_rows for p in parts) == 7 and pa.concat_arrays([p.column(0) for p in parts]).equals(batch.column(0))


def test_buckets_fill_partitions(spark):
    for n in (1, 7, 13, 211):
        df = spark.createDataFrame([(int(x),) for x in frames.bucket_names(n)], "bucket int").repartition(n, "bucket")
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == n


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ten_operators_and_the_pipeline():
    names = list(queries.QUERIES)
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 11)) and "pipeline" in names
