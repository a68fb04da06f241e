"""Queries beside their SQL on tables with odd rows, and models beyond what the driver's small tables have."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.functions import codec, text
from rankloom.operators import external, rankcoder
from rankloom.operators.store import NONE, context_keys
from rankloom.plans import registry

TABLES = {"documents": "doc_id bigint, text varchar, lang varchar", "conversations": "conv_id bigint, turn bigint, text varchar"}


def same(spark, folder, name, **rows):
    """Whether a query gives its SQL's rows over these tables."""
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    for table, columns in TABLES.items():
        con.execute(f"CREATE TABLE {table} ({columns})")
        if rows.get(table):
            given = pa.table({c.split()[0]: list(x) for c, x in zip(columns.split(", "), zip(*rows[table]))})  # noqa: F841
            con.execute(f"INSERT INTO {table} SELECT * FROM given")
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, str(folder)).select(*names).collect()
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_torn_texts_of_few_characters(spark, tmp_path):
    texts = ["a", "abcd", "abcde", "abcdefg", "é漢😀defghi", "abcdefghij", "abcdefghijk", "é" * 40]
    assert same(spark, tmp_path, "torn_texts", documents=[(3 * i + r, t, "en") for i, t in enumerate(texts) for r in range(3)])


def test_torn_texts_without_characters(spark, tmp_path):
    """an empty text, or none, ends no query.  DuckDB 2 has to be told that a remainder of nothing is null."""
    rows = [(3 * i + r, t, "en") for i, t in enumerate(["", None, "a", "abcdefghij"]) for r in range(3)]
    con = duckdb.connect()
    con.execute("SET error_on_division_by_zero = false")
    con.execute(f"CREATE TABLE documents ({TABLES['documents']})")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    want = con.execute(registry.SQL["torn_texts"])
    got = registry.torn_texts(spark, str(tmp_path)).select(*(d[0] for d in want.description)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_a_first_difference_lists_no_characters(spark):
    """places in texts of any length, without an array of their characters."""
    pairs = [("é漢😀x", "é漢😀y"), ("", "a"), ("ab", "ab"), ("a", None), ("ab", "abc"), ("xb", "ab"), ("é" * 70000 + "a", "é" * 70000 + "b"), ("😀" * 65536, "😀" * 65535)]
    told = spark.createDataFrame(pairs, "a string, b string").select(text.first_difference(F.col("a"), F.col("b")).alias("at"))
    assert [r.at for r in told.collect()] == [3, 0, None, None, 2, 0, 70000, 65535]
    assert "split(" not in told._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["word_ids", "rank_encode", "rank_mix", "token_diff"])
def test_a_vocabulary_of_any_size(spark, tmp_path, name):
    """530,000 different words, more than a vocabulary once had: each has an id."""
    docs = [(d, "".join(f" w{d * 1000 + i}" for i in range(1000)), "en") for d in range(530)]
    talk = [(0, 0, " w1 w529999 unseen w529998 w529999"), (0, 1, " w0 w1 w2")]
    assert same(spark, tmp_path, name, documents=docs, conversations=talk)


def test_contexts_of_wide_ids_have_keys_of_their_own():
    ids = np.array([0, 1, (1 << 21) - 1, 1 << 21, 1 << 26])
    one, two = np.repeat(ids, len(ids)), np.tile(ids, len(ids))
    there = np.ones(len(one), bool)
    keys = context_keys([one, two, one], [there, there, two > 0])
    assert len(set(keys[1].tolist()) | set(keys[2].tolist())) == len(ids) + len(one) and (keys[3][two == 0] == NONE).all()
    assert keys[2][1] == 1 + (2 << 21) and keys[2][-1] < 0


def test_sizes_without_bytes(spark):
    """Runs of zeros of every length, pairs before them, ids of every width."""
    rows = [[("r", 3)] * a + [("r", 0)] * n + [("r", 5), ("e", v), ("<BREAK>", 0), ("r", 9)] for a in (0, 1, 2) for n in (0, 1, 2, 62, 63, 64, 125, 126) for v in (5, 8192, 1 << 20)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, s array<{codec.TOKEN}>")
    want = {r.i: r.n - 2 for r in df.select("i", codec.packed_size(F.col("s")).alias("n")).collect()}
    letter = lambda k, v: b"B" if k == "<BREAK>" else (b"2" if v < 8192 else b"3" if v < 1 << 20 else b"4") if k == "e" else b"z" if v == 0 else b"s" if v < 8 else b"L"
    assert {i: rankcoder.body_size(b"".join(letter(*t) for t in r)) for i, r in enumerate(rows)} == want


def test_a_range_of_candidates_is_not_spread_out():
    class Far(external.NextPoints):
        def top_k(self, contexts):
            return [range(c[-1], 1 << 60) for c in contexts]

    assert external.encoded(["ab\x01"], Far()) == [[("e", 97), ("r", 1), ("e", 1)]]
