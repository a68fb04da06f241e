import corpus_pipeline
from near import near_texts
from rankloom.llm import decontaminate, jaccard, lines, queries


def test_stages_keep_columns_and_take_edges(spark, edge_docs, no_docs, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    spark.createDataFrame([(0, 1), (4, 1), (10, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, words)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge_docs, no_docs):
        at = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            path = str(tmp_path / f"{name}-{docs is no_docs}")
            out.write.parquet(path)
            at = spark.read.parquet(path)
        assert at.columns == ["doc_id", "n_tokens", "ids"]


def test_middle_stages_by_brute_force(spark):
    from test_decontaminate import brute as hits
    from test_jaccard import classes
    from test_lines import brute as cut

    docs = near_texts(21)
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long").repartition(3)
    want = [(i, kept) for i, (n, gone, kept) in cut(docs, lines.MIN_WORDS).items() if not gone or gone < n]
    assert sorted((x.doc_id, x.text) for x in lines.clean(df).collect()) == sorted(want)
    assert all(x.n_chars == len(x.text or "") for x in lines.clean(df).collect())
    found = classes(want, jaccard.CORPUS_PERCENT, jaccard.CORPUS_SHINGLE)
    want = [(i, t) for i, t in want if found[i][1] == i]
    assert sorted(x.doc_id for x in jaccard.representatives(lines.clean(df)).collect()) == sorted(i for i, _ in want)
    items = [(0, docs[0][1]), (1, "w1 w2")]
    left = decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    judged = hits(docs, items)
    assert sorted(x.doc_id for x in left.collect()) == sorted(i for i, _ in docs if not judged[i][4])


def test_run(spark):
    rows = queries.QUERIES["pipeline"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(x.n_tokens == len(x.ids) for x in rows) and len({x.doc_id for x in rows}) == len(rows)
