import random

import pytest

from rankloom.llm import lines


def brute(docs, least):
    """Kept texts by the rule: of every repeated run of enough words, of any length, all places but the first (id, line) go."""
    seqs = {i: [x for x in (t or "").split("\n") if x.split()] for i, t in docs}
    seen, gone = set(), {i: set() for i in seqs}
    for i in sorted(seqs):
        s = seqs[i]
        for p in range(len(s)):
            for e in range(p + 1, len(s) + 1):
                key = tuple(s[p:e])
                if key in seen and sum(len(x.split()) for x in key) >= least:
                    gone[i].update(range(p, e))
                seen.add(key)
    out = {}
    for i, t in docs:
        kept, at = [], 0
        for x in (t or "").split("\n"):
            full = bool(x.split())
            if not (full and at in gone[i]):
                kept.append(x)
            at += full
        out[i] = (len(seqs[i]), len(gone[i]), "\n".join(kept) if t is not None else None)
    return out


@pytest.mark.parametrize("seed,least", [(0, 10), (1, 4), (2, 1), (3, 17)])
def test_against_brute_force(spark, seed, least):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefg") for _ in range(r.choice((1, 2, 3, 6, 12)))) for _ in range(9)] + ["", "  "]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.choice((0, 1, 3, 9, 30))))) for i in range(40)] + [(40, None)]
    got = lines.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words=least).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed, x.kept) for x in got} == brute(docs, least)


def test_edges(edge_docs, no_docs, edge_texts):
    got = lines.dedup(edge_docs)
    assert got.count() == len(edge_texts)
    rows = {(x.doc_id, x.text): x for x in got.collect()}
    assert rows[(1, None)].kept is None and rows[(2, "")].n_lines == 0 and rows[(3, " \n\t  ")].kept == " \n\t  "
    assert rows[edge_texts[0]].n_removed == 0 and rows[edge_texts[5]].n_removed == 1
    cleaned = lines.clean(edge_docs)
    assert cleaned.columns == edge_docs.columns and cleaned.where("score <> 'score'").count() == 0
    assert {x.doc_id for x in cleaned.collect()} == {0, 1, 2, 3, 4, None, 7, 8, 9, 10}
    assert lines.dedup(no_docs).count() == 0 and lines.clean(no_docs).count() == 0


def test_whole_runs_go(spark):
    """Two documents share lines of 5, 5, 20 and 3 words: none stays in the copy."""
    lines_ = [" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcd", (5, 5, 20, 3))]
    docs = spark.createDataFrame([(0, "x y z\n" + "\n".join(lines_)), (1, "\n".join(lines_) + "\nz y x")], "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.kept) for x in lines.dedup(docs).collect()}
    assert got[0][0] == 0 and got[1] == (4, "z y x")


def test_long_copies(spark):
    """Runs of many lines, cut at different places, and lines that polynomial hashes confuse."""
    r = random.Random(9)
    base = [f"line {k} " + " ".join(r.choice("abc") for _ in range(r.choice((1, 6)))) for k in range(150)]
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = [(i, "\n".join(base[r.randrange(60) : 150 - r.randrange(60)] + [f"own {i}"])) for i in range(12)]
    docs += [(20, " ".join(one)), (21, " ".join(two)), (22, one), (23, two), (24, None)]
    got = lines.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed, x.kept) for x in got} == brute(docs, 10)
    assert lines.runs(spark.createDataFrame(docs, "doc_id long, text string")).agg({"length": "max"}).first()[0] >= 32


def test_copies_with_a_short_last_line_go(spark):
    text = " ".join(f"w{k}" for k in range(12)) + "\nand so on"
    docs = spark.createDataFrame([(0, text), (1, text), (2, "other")], "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in lines.clean(docs).collect()) == [(0, text), (2, "other")]
