import pytest
from pyspark.sql import functions as F

from rankloom import cli, client
from rankloom.functions import codec, text
from rankloom.operators import external, rankcoder, reports
from rankloom.plans import compress, registry
from rankloom.sources import files, tables
from rankloom.streaming.compress import chunk_stream, compress_stream

TEXTS = ["the cat sat. the cat ran.\n\nthe dog sat on the cat." * 9, "", " ", "naïve 漢字 😀 unseen\twords!", "a" * 1500, "the the the the the"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize("how", ["words", "codepoints"])
def test_round_trip_of_unseen_texts(spark, docs, how):
    model = compress.Model.fit(docs.where("doc_id = 0"), how=how)
    for window in (1, 2, 100):
        payloads = compress.compress(docs, model, window)
        assert {r.doc_id: (r.text, r.error) for r in compress.decompress(payloads, model, strict=True).collect()} == {i: (t, None) for i, t in enumerate(TEXTS)}
    assert payloads.where("doc_id = 1").first().payload == bytearray(b"\x80\xe4")
    sizes = {r.doc_id: r.compressed_size for r in compress.sizes(docs, model, 100).collect()}
    assert sizes == {r.doc_id: len(r.payload) for r in payloads.collect()}
    chunks = {r.doc_id: r.chunks for r in compress.decompress_chunks(payloads, model).collect()}
    assert {i: "".join(c) for i, c in chunks.items()} == dict(enumerate(TEXTS)) and len(chunks[0]) > 1


def test_contexts_by_hand(spark):
    """a b a c a b: after "b a" only c was seen once, too seldom; after "a" b twice, c once."""
    docs = spark.createDataFrame([(0, " a b a c a b")], "doc_id long, text string")
    model = compress.Model.fit(docs, least=1, most=100)
    ids = {r.token: r.token_id for r in model.vocab.collect()}
    assert ids == {" a": 0, " b": 1, " c": 2}
    lists = {}
    for r in model.ranks.orderBy("ctx", "rank").collect():
        lists.setdefault(r.ctx, []).append(r.token_id)
    assert lists == {0: [0, 1, 2], 1: [1, 2], 2: [0], 3: [0]}
    coded = [(r.kind, r.value) for r in compress.coded(docs, model).orderBy("pos").collect()]
    assert coded == [("e", 0), ("r", 0), ("r", 0), ("r", 1), ("r", 0), ("r", 0)]
    # Two tokens of context: "a b" and "b a" of a longer text are known, so window 2 finds what window 1 does not.
    docs = spark.createDataFrame([(0, " a b x a b x" + " q a b y" * 3 + " z b y")], "doc_id long, text string")
    model = compress.Model.fit(docs, least=1, most=100)
    kinds = {w: [r.value for r in compress.coded(docs, model, w).orderBy("pos").collect()] for w in (1, 2, 3)}
    assert kinds[1] != kinds[2]
    assert kinds[2][2] == kinds[2][5]  # x after "a b"


def test_model_is_kept(spark, docs, tmp_path):
    model = compress.Model.fit(docs, "m")
    model.save(str(tmp_path / "m"))
    again = compress.Model.load(spark, str(tmp_path / "m"))
    assert again.name == "m" and compress.compress(docs, model).select("payload").collect() == compress.compress(docs, again).select("payload").collect()
    ids = [r.token_id for r in model.vocab.orderBy(F.desc("n"), "token").collect()]
    assert ids == list(range(len(ids)))


def test_a_bounded_model_loses_nothing(spark, docs):
    whole = compress.Model.fit(docs)
    small = compress.Model.fit(docs, most_tokens=4, most_ranks=9, k=3)
    assert small.vocab.count() == 4 and small.ranks.count() <= 9 < whole.ranks.count()
    assert compress.Model.fit(docs, most_ranks=0).ranks.count() == 0
    back = compress.decompress(compress.compress(docs, small), small)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(TEXTS))


def test_report_and_sweep(spark, docs):
    model = compress.Model.fit(docs)
    both = docs.union(spark.createDataFrame([(99, None)], docs.schema))
    told = compress.report(both, model)
    rows = {r.doc_id: r for r in told.collect()}
    assert all(r.identical and r.identical_bytes and r.tokens_identical and r.error is None for i, r in rows.items() if i != 99)
    assert rows[99].error == "no text" and rows[99].compressed_size is None and not rows[99].identical
    assert rows[1].space_savings is None and rows[1].compression_ratio == 0
    total = reports.corpus(told).first()
    assert total.n_files == len(TEXTS) + 1 == total.n_identical + 1 and total.original_size == sum(len(t.encode()) for t in TEXTS)
    table = compress.sweep(docs, model, [1, 2, 3, 20, 36])
    got = {r.window_size: r for r in table.collect()}
    assert set(got) == {1, 2, 3, 20, 36} and got[1].compressed_size != got[2].compressed_size and got[3].compressed_size == got[36].compressed_size
    assert reports.displayed(reports.corpus(told)).first().compression_ratio.endswith("x")
    timed = compress.sweep(docs.limit(3), model, [1, 2], timed=True)
    assert reports.fastest_window(timed).first().window_size in (1, 2) and reports.best_window(timed).count() == 1


def test_bad_payloads_are_rows(spark, docs):
    model = compress.Model.fit(docs)
    raw = [b"\x80\xc0\x81", b"", None, b"\x80\xc0\x81\x81\x3f", b"\x80\x80\x81\x81"]  # cut off, empty, none, no such candidate, window 0
    rows = spark.createDataFrame(list(enumerate(map(lambda x: None if x is None else bytearray(x), raw))), "doc_id long, payload binary")
    strict = {r.doc_id: r.error for r in compress.decompress(rows, model, strict=True).collect()}
    assert strict[0] == "cut off inside an id" and strict[1] == "no header" and strict[2] == "no payload"
    assert strict[3].startswith("not of this model") and strict[4].startswith("not of this model")
    loose = {r.doc_id: r for r in compress.decompress(rows, model).collect()}
    assert loose[0].error is None and loose[1].text == "" and loose[2].error == "no payload"


def test_window_and_candidates_are_checked(spark, docs):
    with pytest.raises(ValueError):
        rankcoder.reach(0)
    with pytest.raises(ValueError):
        rankcoder.rank_table(docs, 65)
    with pytest.raises(ValueError):
        rankcoder.vocabulary(docs, 1 << 21)


def test_single_texts(spark, docs):
    model = compress.Model.fit(docs)
    for t in TEXTS:
        assert client.detokenize(model, client.tokenize(model, t, 2), 2) == t
    assert client.predict_next_words(model, "on the", 2)[0] == " cat"
    assert client.word_of(model, client.token_ids(model, "the zebra")) == "the zebra" and client.word_of(model, 0) in TEXTS[0]
    with pytest.raises(ValueError):
        client.detokenize(model, [("r", 63)])
    client.register_functions(spark, model)
    assert [r.unit for r in spark.sql("SELECT unit FROM (SELECT X'80C058C2' AS p), LATERAL rank_units(p) ORDER BY pos").collect()] == ["80C0", "58", "C2"]
    assert spark.sql("SELECT next FROM (SELECT ' the' AS w), LATERAL rank_next(w) WHERE rank = 0").first().next == " cat"
    assert client.resources(spark) == {}


class Grams:
    """A model of its own: letters, and after each the letters in the order of their distance."""

    made = 0

    def __init__(self):
        Grams.made += 1

    def tokenize(self, text):
        return [ord(c) for c in text]

    def detokenize(self, ids):
        return "".join(map(chr, ids))

    def top_k(self, contexts):
        return [sorted(range(max(0, sum(c) // len(c) - 40), sum(c) // len(c) + 40), key=lambda x: (abs(x - c[-1]), x))[:64] for c in contexts]


def test_external_model():
    model, chunks = external.loaded(Grams), ["", "a", "hello world", "naïve 漢字 😀", "aaa"]
    assert external.loaded(Grams) is model and Grams.made == 1
    for window in (1, 3, 64):
        coded = external.encoded(chunks, model, window)
        assert external.decoded(coded, model, window) == chunks
    assert coded[4] == [("e", 97), ("r", 0), ("r", 0)] and coded[0] == []


def test_files(spark, tmp_path):
    raw = {"a.py": b"a\r\nb\rc", "b.txt": "é漢".encode(), "c.md": b"\xe9A", "d": b"", ".hidden": b"x", "_under.txt": b"y"}
    for name, content in raw.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.txt").write_bytes(b"no")
    got = {r.file_name: r for r in files.scan_texts(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "b.txt", "c.md", "d"}
    assert (got["a.py"].text, got["a.py"].original_size, got["a.py"].file_type) == ("a\nb\nc", 6, "python")
    assert (got["c.md"].text, got["c.md"].encoding) == ("éA", "latin-1") and got["b.txt"].encoding == "utf-8"
    assert {r.path.rsplit("/", 1)[1] for r in files.scan_bytes(spark, str(tmp_path), hidden=True).collect()} == set(raw) - {".hidden"}
    assert files.scan_texts(spark, str(tmp_path), utf8_only=True).where("file_name = 'c.md'").first().text is None
    dirs = files.output_dirs(spark, str(tmp_path / "out"), True)
    files.write_files(spark.createDataFrame([("x", bytearray(b"\x00\xff"))], "n string, b binary"), dirs["compressed"], "n", "b", ".bin")
    assert (tmp_path / "out/Compressed/x.bin").read_bytes() == b"\x00\xff"


def test_same_text_and_first_difference(spark):
    df = spark.createDataFrame([(b"a\r\nb", b"a\nb"), (b"a", b"b"), (b"\xff", b"\xff")], "a binary, b binary")
    assert [r[0] for r in df.select(text.same_text(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    df = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("", "x"), ("x", "x")], "a string, b string")
    assert [r[0] for r in df.select(text.first_difference(F.col("a"), F.col("b"))).collect()] == [2, 2, 0, None]


@pytest.mark.parametrize("kind,count", [("python", 4), ("java", 4), ("html", 4), ("markdown", 4), ("json", 4), ("xml", 4), ("general", 3)])
def test_typed_pieces(spark, kind, count):
    given = {
        "python": "def f(a):\n    return a\nclass A:\n    pass\n\nx = 1",
        "java": "class A {\n int x;\n}\n\n// end",
        "html": "<p>one</p>\n<!-- two --><b>three</b> four",
        "markdown": "one\n# Head\ntext\n- item\n\n1. last",
        "json": '{\n"a": 1,\n"b": [\n2]}',
        "xml": "<a><b/>one</a>\n<c>two</c> three",
        "general": "One line.\nNo end\n\nlast",
    }[kind]
    got = spark.createDataFrame([(given,)], "t string").select(text.typed_pieces(F.col("t"), kind).alias("p")).first().p
    assert "".join(got) == given and len(got) == count


def test_token_diff(spark):
    rows = "doc_id long, pos int, kind string, value int"
    a = spark.createDataFrame([(0, 0, "e", 5), (0, 1, "r", 0), (0, 2, "r", 1)], rows)
    b = spark.createDataFrame([(0, 0, "e", 5), (0, 1, "r", 3)], rows)
    d = reports.token_diff(a, b)
    assert sorted(r.pos for r in d.collect()) == [1, 2]
    assert reports.difference_rate(d, a).first().n_diffs == 2
    assert reports.dump_lines(a).orderBy("pos").first().line == "    0 | Expl | 5"


def test_stream(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    model = compress.Model.fit(docs)
    source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    compress_stream(source, model, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.text for r in compress.decompress(got, model).collect()} == dict(enumerate(TEXTS))
    assert chunk_stream(source).isStreaming


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXTS[0])
    (tmp_path / "in" / "b.txt").write_bytes(b"one\r\ntwo \xe9")
    out = tmp_path / "out"
    cli.main(["folder", "--input", str(tmp_path / "in"), "--output", str(out), "--debug"])
    assert (out / "Results/a.txt").read_text() == TEXTS[0] and (out / "Results/b.txt").read_bytes() == "one\ntwo é".encode()
    assert (out / "Compressed/a.txt.bin").stat().st_size > 2 and (out / "Debug/b.txt.original").read_bytes() == b"one\r\ntwo \xe9"
    assert "Tokens: " in (out / "Debug/a.txt.tokens.txt").read_text() and (out / "Debug/a.txt.comparison.txt").read_text().startswith("Tokens are identical")
    assert "latin-1" in capsys.readouterr().out
    (out / "Compressed/c.txt.bin").write_bytes(b"\x00")
    cli.main(["decompress", "--input", str(out / "Compressed"), "--output", str(tmp_path / "again"), "--model", str(out / "Model"), "--strict"])
    assert (tmp_path / "again/a.txt").read_text() == TEXTS[0] and "c.txt | no header" in capsys.readouterr().out
    cli.main(["windows", "--input", str(tmp_path / "in"), "--num-tests", "2", "--start-size", "1", "--increment", "1"])
    cli.main(["chunks", "--input", str(tmp_path / "in"), "--tokenize", "--output", str(tmp_path / "joined")])
    assert "window_size" in capsys.readouterr().out and (tmp_path / "joined/a.txt").read_text() == TEXTS[0]
    cli.main(["resources"])
    with pytest.raises(SystemExit):
        cli.main(["resources", "--strict"])


def test_queries():
    assert set(registry.QUERIES) - set(registry.SQL) == {"fastest_window"} and registry.FLAGSHIP in registry.QUERIES
    assert codec.WINDOW == 64


def test_kept_tables_are_made_once_and_again_after_clearing(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.kept(spark, ("test",), make).count() == 3
    assert made == [1]
    tables.drop_path(spark, tables._kept[(spark.sparkContext.applicationId, tables.own_dir(spark), "test")])
    assert tables.kept(spark, ("test",), make).count() == 3 and made == [1, 1]


def test_text_sources(spark):
    assert files.from_texts(spark.createDataFrame([("é",)], "text string")).first().original_size == 2
