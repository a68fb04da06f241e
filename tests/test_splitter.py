import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions.splitter import joined, oversized, split_text


def chunks(spark, texts, least, most):
    c = split_text(F.col("text"), least, most)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", "text", c.alias("c"), joined(c).alias("j")).collect()
    return {r.id: r for r in rows}


CASES = [
    # text, least, most, chunks worked out by hand
    ("", 5, 20, []),
    ("abc", 5, 20, ["abc"]),
    ("aaaaaa\n\nbbbbbb\n\ncc", 5, 20, ["aaaaaa\n\n", "bbbbbb\n\ncc"]),  # the short rest joins the chunk before it
    ("aa\n\nbb\n\ncc\n\n", 5, 20, ["aa\n\nbb\n\ncc\n\n"]),  # so does a rest that ends at a delimiter
    ("a\n---\nbbbbb\n===\nc", 5, 20, ["a\n---\n", "bbbbb\n===\nc"]),  # rules end pieces
    ("a" * 31 + "\n\n" + "b" * 25, 5, 20, ["a" * 31 + "\n", "\n", "b" * 25]),  # far too long: cut at the line ends, whatever comes out
    ("One two. Three four! Five six? Seven eight nine.", 10, 20, ["One two. Three four! ", "Five six? ", "Seven eight nine."]),
    ("x" * 100, 5, 20, ["x" * 100]),  # nothing to cut at
    ("é漢😀\n\n" * 3, 4, 8, ["é漢😀\n\n"] * 3),  # lengths are code points
]


@pytest.mark.parametrize("text,least,most,want", CASES)
def test_by_hand(spark, text, least, most, want):
    assert chunks(spark, [text], least, most)[0].c == want


@pytest.mark.parametrize("least,most", [(100, 500), (10, 40), (40, 10), (1, 5), (500, 2000)])
def test_properties(spark, least, most):
    r = random.Random(least * 1000 + most)
    texts = ["", "x" * 2000, "a\n\nb", "é. 漢!\n\n😀? ok"]
    for _ in range(120):
        n = r.randint(1, 60)
        texts.append("".join(r.choice(("word ", "a", "End. ", "Why?  ", "\n", "\n\n", "\n---\n", "\n=====\n", "long" * 9, "é漢😀", "!\t")) for _ in range(n)))
    for i, row in chunks(spark, texts, least, most).items():
        assert row.j == texts[i] and all(row.c)
        # A chunk below the least size is the last one, or lies in a stretch that was cut again.
        if len(texts[i]) <= 1.5 * most:
            assert all(len(c) >= least for c in row.c[:-1])


def test_oversized(spark):
    df = spark.createDataFrame([("x" * 751,), ("x" * 750,)], "c string")
    assert [r[0] for r in df.select(oversized(F.col("c"), 500)).collect()] == [True, False]
