import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.functions import codec

STREAM = f"id int, stream array<{codec.TOKEN}>"


def pack(tokens, w=64):
    """An independent statement of the format."""

    def explicit(v):
        if v < 1 << 13:
            return [0x80 | v >> 7, 0x80 | v & 127]
        if v < 1 << 20:
            return [0x80 | v >> 14, v >> 7 & 127, 0x80 | v & 127]
        return [0x80 | v >> 21, v >> 14 & 127, v >> 7 & 127, 0x80 | v & 127]

    out, i = explicit(w), 0
    while i < len(tokens):
        kind, v = tokens[i]
        if kind == "<BREAK>":
            out.append(0xFF)
            i += 1
            continue
        n = 0
        while i + n < len(tokens) and tokens[i + n] == ("r", 0):
            n += 1
        if n >= 2:
            i += n
            while n > 0:
                out.append(0xC0 | min(n, 62))
                n -= 62
        elif kind == "r" and v < 8 and i + 1 < len(tokens) and tokens[i + 1][0] == "r" and tokens[i + 1][1] < 8:
            out.append(0x40 | v << 3 | tokens[i + 1][1])
            i += 2
        elif kind == "r":
            out.append(v)
            i += 1
        else:
            out += explicit(v)
            i += 1
    return bytes(out)


def streams(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        s = []
        for _ in range(r.randint(0, 12)):
            k = r.random()
            if k < 0.35:
                s += [("r", 0)] * r.choice((1, 1, 2, 3, 61, 62, 63, 124, 125, 200))
            elif k < 0.6:
                s.append(("r", r.randint(0, 7)))
            elif k < 0.75:
                s.append(("r", r.randint(8, 63)))
            elif k < 0.9:
                s.append(("e", r.choice((0, 1, 127, 128, 8191, 8192, 1048575, 1048576, 134217727, r.randrange(1 << 27)))))
            else:
                s.append(("<BREAK>", 0))
        yield s


def test_encode_decode_and_size(spark):
    every = list(enumerate(streams(1, 300)))
    df = spark.createDataFrame(every, STREAM).withColumn("w", F.pmod(F.col("id") * 7919 * 131, F.lit(2_000_000)) + 1)
    rows = df.select("id", "w", "stream", codec.encode(F.col("stream"), F.col("w")).alias("b"), codec.packed_size(F.col("stream"), F.col("w")).alias("n"))
    back = rows.withColumn("d", codec.decode(F.col("b"))).collect()
    for r in back:
        tokens = [(t.kind, t.value) for t in r.stream]
        assert bytes(r.b) == pack(tokens, r.w)
        assert r.n == len(r.b)
        assert (r.d.window, [(t.kind, t.value) for t in r.d.tokens]) == (r.w, tokens)


def test_pairs(spark):
    df = spark.createDataFrame([(0, [("r", 3), ("r", 0), ("e", 1), ("r", 7), ("r", 8), ("r", 1), ("<BREAK>", 0), ("r", 1), ("r", 1)]), (1, []), (2, [("r", 1)])], STREAM)
    assert [r[0] for r in df.orderBy("id").select(codec.pairs(F.col("stream"))).collect()] == [2, 0, 0]


def test_greedy_order_and_empty(spark):
    df = spark.createDataFrame([(0, [("r", 3), ("r", 0), ("r", 0), ("r", 0)]), (1, [])], STREAM)
    got = {r.id: r.h for r in df.select("id", codec.encode_hex(F.col("stream")).alias("h")).collect()}
    assert got == {0: "80C058C2", 1: "80C0"}


@pytest.mark.parametrize("bad", [("e", 1 << 27), ("r", 64), ("r", -1)])
def test_out_of_range(spark, bad):
    with pytest.raises(Exception):
        spark.createDataFrame([(0, [bad])], STREAM).select(codec.encode(F.col("stream"))).collect()


@pytest.mark.parametrize("w", [0, 1 << 27])
def test_bad_window(spark, w):
    with pytest.raises(Exception):
        spark.createDataFrame([(0, [("r", 1)])], STREAM).select(codec.encode(F.col("stream"), w)).collect()


#: An explicit id: its first byte, then bytes with the high bit clear until one has it set, three at most or as far as the stream goes.
ID = re.compile(rb"[\x80-\xbf](?:[\x80-\xff]|[\x00-\x7f][\x80-\xff]|[\x00-\x7f]{2}[\x80-\xff]|[\x00-\x7f]{1,2})?", re.S)


def unpack(data):
    """The format read from its bits."""
    w, out = 64, []
    if len(data) >= 2 and ID.match(data):
        head = ID.match(data).group()
        w, data = number(head), data[len(head) :]
    while data:
        bits, size = f"{data[0]:08b}", 1
        if bits == "11111111":
            out.append(("<BREAK>", 0))
        elif bits.startswith("10"):
            unit = ID.match(data).group()
            size = len(unit)
            out.append(("e", number(unit)))
        elif bits.startswith("01"):
            out += [("r", int(bits[2:5], 2)), ("r", int(bits[5:], 2))]
        else:
            out += [("r", 0)] * int(bits[2:], 2) if bits.startswith("11") else [("r", int(bits, 2))]
        data = data[size:]
    return w, out


def number(unit):
    return int(f"{unit[0]:08b}"[2:] + "".join(f"{b:08b}"[1:] for b in unit[1:]), 2)


def test_any_bytes_decode(spark):
    r = random.Random(3)
    raw = [bytes(r.choice((r.randrange(256), 0x81, 0x05, 0x90, 0xFF, 0xC0)) for _ in range(r.randint(0, 14))) for _ in range(300)]
    whole = pack([("e", 1 << 26), ("r", 9), ("e", 9000)], 5000)
    raw += [whole[:n] for n in range(len(whole) + 1)]
    df = spark.createDataFrame(list(enumerate(map(bytearray, raw))), "id int, b binary")
    for x in df.select("b", codec.decode(F.col("b")).alias("d")).collect():
        assert (x.d.window, [(t.kind, t.value) for t in x.d.tokens]) == unpack(bytes(x.b))


def test_strict_refuses_a_cut_stream(spark):
    df = spark.createDataFrame([(bytearray(b"\x80\xc0\x81\x05"),)], "b binary")
    with pytest.raises(Exception):
        df.select(codec.decode(F.col("b"), strict=True)).collect()
    assert df.select(codec.decode(F.col("b")).alias("d")).first().d.window == 64


def test_breaks(spark):
    e, b = ("e", 5), ("<BREAK>", 0)
    cases = [[], [e], [e, b, e], [b, e], [e, b], [e, b, b, e], [b]]
    want = [[], [[e]], [[e], [e]], [[], [e]], [[e]], [[e], [], [e]], [[]]]
    df = spark.createDataFrame(list(enumerate(cases)), STREAM)
    got = {r.id: [[(t.kind, t.value) for t in c] for c in r.c] for r in df.select("id", codec.split_breaks(F.col("stream")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == want
    chunks = [[], [[e]], [[e], [e, e]], [[], [e]], [[e], [], [e]]]
    df = spark.createDataFrame(list(enumerate(chunks)), f"id int, c array<array<{codec.TOKEN}>>")
    back = {r.id: [[(t.kind, t.value) for t in c] for c in r.b] for r in df.select("id", codec.split_breaks(codec.combine(F.col("c"))).alias("b")).collect()}
    assert [back[i] for i in range(len(chunks))] == chunks
