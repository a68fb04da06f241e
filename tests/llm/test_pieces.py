import random

import pytest
import sentencepiece

from rankloom.llm import frames, pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(pieces.MODEL)


def test_like_the_library(spark, model, edge_texts, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 20_000)  # several blocks
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(1)
    alphabet = ["the ", "ing", "\n", "\t", "  ", "é", "漢字", "😀", "=====", "a", "e", ", ", ";\r", "▁", "�", "\x00", "international "]
    texts = [t for _, t in edge_texts] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(150)] + ["ab" * 400, " " * 40, "x" * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = pieces.decode(pieces.encode(docs)).collect()
    assert len(got) == len(texts)
    assert sorted(got) == sorted(pieces.encode(docs, decoded=True).collect())
    for x in got:
        t = texts[x.doc_id] or ""
        assert list(x.ids) == library.encode(t)
        assert x.text == t.replace("▁", " ")


def test_input_that_is_not_a_read_of_files(spark, tmp_path, monkeypatch):
    """Shuffled rows are written first; a read of files is walked as it is; long and look-alike chunks."""
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r, one = random.Random(3), "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    texts = [one, one.translate(str.maketrans("ab", "ba")), "ab" * 50, "x" * 3000, "".join(r.choice("abcdefgh") for _ in range(700))]
    texts += [" ".join(r.choice(("the", "cat", "sat", "international")) for _ in range(r.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert frames.settled(read.where("doc_id >= 0").select("text", "doc_id")).inputFiles() == read.inputFiles()
    monkeypatch.setattr(pieces, "_spelled", without_python(pieces._spelled))
    for df in (read.repartition(5, "text"), read.join(docs.select("doc_id"), "doc_id")):
        assert {x.doc_id: list(x.ids) for x in pieces.encode(df).collect()} == {i: library.encode(t) for i, t in enumerate(texts)}


def without_python(spelled):
    """Chunks of up to LONG characters come with their borders."""

    def made(model):
        spell = spelled(model)

        def ids(chunk, b, cuts):
            assert len(chunk) > pieces.LONG or b is not None or cuts is not None
            return spell(chunk, b, cuts)

        return ids

    return made


def test_pieces_are_in_order(model):
    assert pieces.out_of_order(model) == []
    odd = pieces.Model(["<unk>", "ab", "abc"], [0.0, -9.0, -1.0], [2, 1, 1], False, 0)
    assert pieces.out_of_order(odd) == ["abc"]


@pytest.mark.parametrize("seed", [0, 1])
def test_unigram_is_viterbi(spark, seed):
    r = random.Random(seed)
    found = sorted({"".join(r.choice("abc▁") for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(12)})
    found = [p for p in found if "▁" not in p.lstrip("▁")]
    model = pieces.Model(["<unk>", *found], [0.0, *(-r.random() * 9 for _ in found)], [2, *(1 for _ in found)], True, 0)
    texts = ["".join(r.choice("abcd ") for _ in range(r.choice((0, 1, 5, 12, 80)))) for _ in range(60)]
    use = model.usable()

    def best(text):
        """The best score over all paths; a character without piece costs more than any piece."""
        v = [0.0] + [-1e18] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 4), e):
                i = use.get(text[s:e])
                w = model.scores[i] if i is not None else min(model.scores) - 10 if e == s + 1 else -1e18
                v[e] = max(v[e], v[s] + w)
        return v[-1]

    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=model).collect()
    for x in rows:
        text = ("▁" + texts[x.doc_id].replace(" ", "▁")) if texts[x.doc_id] else ""
        score = sum(model.scores[i] if i else min(model.scores) - 10 for i in x.ids)
        assert score == pytest.approx(best(text))


def test_edges(edge_docs, no_docs, edge_texts):
    got = pieces.encode(edge_docs)
    assert got.columns == ["doc_id", "ids"] and got.count() == len(edge_texts)
    assert pieces.decode(pieces.encode(no_docs)).count() == 0
