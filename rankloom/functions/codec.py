"""The byte codec for coded tokens, as native expressions.

A coded token is (kind, value): ('r', rank 0..63), ('e', id below 2**27) or ('<BREAK>', 0).
Tokens are written as eight characters each, a class letter and seven hex digits, so that a
regular expression finds the packing units with their values in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANK, EXPLICIT, BREAK = "r", "e", "<BREAK>"
TOKEN = "struct<kind:string,value:int>"

#: Fixed values of the byte format.
RUN_MOST = 62  # zeros in one run byte, 11nnnnnn
RANKS = 64  # ranks in one byte, 00rrrrrr
SMALL = 8  # ranks that pair, 01aaabbb
EXPLICIT_2, EXPLICIT_3, EXPLICIT_4 = 1 << 13, 1 << 20, 1 << 27  # explicit ids below these take 2, 3, 4 bytes
WINDOW = 64  # where a stream has no header

#: Packing units, in the order of preference: a run of zeros, a pair of small ranks, one token.
UNITS = r"(?:z.{7}){2,}|[zs].{7}[zs].{7}|[zsLEB].{7}"
#: Units of a byte stream in upper-case hex; an explicit id ends at its first byte with the high bit, or as far as the stream goes.
BYTES = r"[89AB].(?:[89A-F].|[0-7].(?:[89A-F].|[0-7].[89A-F].|[0-7].)?)?|[0-7C-F]."


def token(kind: str | Column, value: Column | int) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    v = F.lit(value) if isinstance(value, int) else value
    return F.struct(k.alias("kind"), v.cast("int").alias("value"))


def is_break(t: Column) -> Column:
    return t["kind"] == BREAK


def pairable(a: Column, b: Column) -> Column:
    return (a["kind"] == RANK) & (b["kind"] == RANK) & (a["value"] < SMALL) & (b["value"] < SMALL)


def _written(t: Column) -> Column:
    bad = (t["value"] < 0) | ((t["kind"] == RANK) & (t["value"] >= RANKS)) | (t["value"] >= EXPLICIT_4)
    letter = (
        F.when(t["kind"] == BREAK, "B").when(t["kind"] != RANK, "E")
        .when(t["value"] == 0, "z").when(t["value"] < SMALL, "s").otherwise("L")
    )
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no code for "), t["kind"], F.lit(" "), t["value"].cast("string")))).otherwise(letter)
    return F.concat(checked, F.lpad(F.hex(t["value"]), 7, "0"))


def written(stream: Column) -> Column:
    return F.array_join(F.transform(stream, _written), "")


def units(stream: Column) -> Column:
    """The packing units of a stream, as text."""
    return F.regexp_extract_all(written(stream), F.lit(UNITS), F.lit(0))


def _value(unit: Column, at: int = 0) -> Column:
    return F.conv(F.substring(unit, 2 + 8 * at, 7), 16, 10).cast("bigint")


def _byte(v: Column) -> Column:
    return F.lpad(F.hex(v), 2, "0")


def explicit_hex(v: Column) -> Column:
    """10hhhhhh, middle bytes 0mmmmmmm, last byte 1lllllll."""
    part = lambda shift, mask: F.shiftright(v, shift).bitwiseAND(mask)
    last = _byte(part(0, 127).bitwiseOR(128))
    middle = lambda shift: _byte(part(shift, 127))
    return (
        F.when(v < EXPLICIT_2, F.concat(_byte(part(7, 63).bitwiseOR(128)), last))
        .when(v < EXPLICIT_3, F.concat(_byte(part(14, 63).bitwiseOR(128)), middle(7), last))
        .when(v < EXPLICIT_4, F.concat(_byte(part(21, 63).bitwiseOR(128)), middle(14), middle(7), last))
        .otherwise(F.raise_error(F.lit("an explicit id must be below 2**27")))
    )


def explicit_width(v: Column) -> Column:
    return F.when(v < EXPLICIT_2, 2).when(v < EXPLICIT_3, 3).when(v < EXPLICIT_4, 4).otherwise(F.raise_error(F.lit("an explicit id must be below 2**27")))


def _unit_hex(u: Column) -> Column:
    size, kind = F.length(u), F.substring(u, 1, 1)
    run = (size / 8).cast("int")
    zeros = F.concat(F.repeat(F.lit("FE"), F.floor((run - 1) / RUN_MOST).cast("int")), _byte(F.pmod(run - 1, F.lit(RUN_MOST)) + 1 + 0xC0))
    is_run = (kind == "z") & (size > 8) & (F.substring(u, 9, 1) == "z")
    return (
        F.when(is_run, zeros)
        .when(size == 16, _byte(F.shiftleft(_value(u), 3).bitwiseOR(_value(u, 1)).bitwiseOR(0x40)))
        .when(kind == "E", explicit_hex(_value(u)))
        .when(kind == "B", "FF")
        .otherwise(_byte(_value(u)))
    )


def _checked_window(window: Column | int) -> Column:
    w = (F.lit(window) if isinstance(window, int) else window).cast("bigint")
    return F.when((w >= 1) & (w < EXPLICIT_4), w).otherwise(F.raise_error(F.lit("a window is from 1 to 2**27 - 1")).cast("bigint"))


def encode_hex(stream: Column, window: Column | int = WINDOW) -> Column:
    """Header and units, as upper-case hex."""
    return F.concat(explicit_hex(_checked_window(window)), F.array_join(F.transform(units(stream), _unit_hex), ""))


def encode(stream: Column, window: Column | int = WINDOW) -> Column:
    return F.unhex(encode_hex(stream, window))


def packed_size(stream: Column, window: Column | int = WINDOW) -> Column:
    """The number of bytes that encode() gives, without making them."""

    def size(u: Column) -> Column:
        n = F.length(u)
        run = F.ceil(n / 8 / RUN_MOST).cast("bigint")
        is_run = (F.substring(u, 1, 1) == "z") & (n > 8) & (F.substring(u, 9, 1) == "z")
        return F.when(is_run, run).when(F.substring(u, 1, 1) == "E", explicit_width(_value(u))).otherwise(1).cast("bigint")

    head = explicit_width(_checked_window(window)).cast("bigint")
    return F.aggregate(units(stream), head, lambda a, u: a + size(u))


def decode_units(hexed: Column) -> Column:
    return F.regexp_extract_all(hexed, F.lit(BYTES), F.lit(0))


def _explicit_value(u: Column) -> Column:
    byte = lambda i: F.conv(F.substring(u, 2 * i + 1, 2), 16, 10).cast("bigint")
    low = lambda i, shift: F.shiftleft(byte(i).bitwiseAND(127), shift)
    head = lambda shift: F.shiftleft(byte(0).bitwiseAND(63), shift)
    n = F.length(u)
    return (
        F.when(n == 2, head(0)).when(n == 4, head(7) + low(1, 0)).when(n == 6, head(14) + low(1, 7) + low(2, 0))
        .otherwise(head(21) + low(1, 14) + low(2, 7) + low(3, 0))
    )


def _unit_tokens(u: Column) -> Column:
    v = F.conv(u, 16, 10).cast("bigint")
    low = v.bitwiseAND(63)
    one = lambda k, x: F.array(token(k, x))
    first = F.substring(u, 1, 1)
    return (
        F.when(u == "FF", one(BREAK, F.lit(0)))
        .when(first.rlike("[89AB]"), one(EXPLICIT, _explicit_value(u)))
        .when(first.rlike("[0-3]"), one(RANK, low))
        .when(first.rlike("[4-7]"), F.array(token(RANK, F.shiftright(low, 3)), token(RANK, low.bitwiseAND(7))))
        .otherwise(F.array_repeat(token(RANK, 0), low.cast("int")))
    )


def decode(payload: Column, strict: bool = False) -> Column:
    """(window, tokens) of a byte stream.  strict: a stream without header, or cut off inside an id, is an error."""
    return decode_hex(F.hex(payload), strict)


def _headed(hexed: Column) -> Column:
    return (F.length(hexed) >= 4) & F.substring(hexed, 1, 1).rlike("[89AB]")


def fault(payload: Column) -> Column:
    """Why a byte stream is no whole coded stream; null if it is one."""
    hexed = F.hex(payload)
    whole = F.forall(decode_units(hexed), lambda u: ~u.rlike("^[89AB]") | ((F.length(u) >= 4) & F.substring(u, -2, 1).rlike("[89A-F]")))
    return F.when(~_headed(hexed), "no header").when(~whole, "cut off inside an id")


def decode_hex(hexed: Column, strict: bool = False) -> Column:
    us, headed = decode_units(hexed), _headed(hexed)
    if strict:
        wrong = fault(F.unhex(hexed))
        us = F.when(wrong.isNull(), us).otherwise(F.raise_error(F.concat(F.lit("not a whole coded stream: "), wrong)).cast("array<string>"))
    window = F.when(headed, _explicit_value(F.get(us, F.lit(0)))).otherwise(F.lit(WINDOW)).cast("int")
    rest = F.when(headed, F.slice(us, 2, F.greatest(F.size(us) - 1, F.lit(0)))).otherwise(us)
    return F.struct(window.alias("window"), F.flatten(F.transform(rest, _unit_tokens)).alias("tokens"))


def leading_zeros(stream: Column) -> Column:
    """Length of the run of rank 0 at the start."""
    return F.length(F.regexp_extract(written(stream), r"^((?:z.{7})*)", 1)) / 8


def pairs(stream: Column) -> Column:
    """How many neighbours could share a byte."""
    next_ = F.slice(stream, 2, F.greatest(F.size(stream) - 1, F.lit(0)))
    both = F.zip_with(F.slice(stream, 1, F.size(next_)), next_, pairable)
    return F.size(F.filter(both, lambda p: p))


def zero_runs(stream: Column) -> Column:
    """Lengths of the runs of two zeros or more."""
    return F.transform(F.regexp_extract_all(written(stream), F.lit(r"(?:z.{7}){2,}"), F.lit(0)), lambda u: (F.length(u) / 8).cast("int"))


def combine(chunks: Column) -> Column:
    """The tokens of all chunks, with a break between two chunks."""
    brk = F.array(token(BREAK, 0))
    return F.flatten(F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(brk, c)).otherwise(c)))


def split_breaks(stream: Column) -> Column:
    """The inverse: the chunks of a stream.  An empty chunk at the end is dropped, other empty ones are kept."""
    ends = F.concat(F.filter(F.transform(stream, lambda t, i: F.when(is_break(t), i)), lambda x: x.isNotNull()), F.array(F.size(stream)))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
    cut = F.zip_with(starts, ends, lambda s, e: F.slice(stream, s + 1, e - s))
    last_empty = F.element_at(starts, -1) == F.size(stream)
    return F.when(last_empty, F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
