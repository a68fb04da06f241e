"""Cutting texts into chunks of bounded size, as one native expression.

Pieces end at blank lines or rule lines and are packed greedily; a chunk far too long is cut
again at line and sentence ends.  Lengths are code points.  Joined chunks are the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A piece and its delimiter; the first at blank lines and rules, the second at lines and sentences.
PARAGRAPH = r"(?s).*?(?:\n\n|\n[-=*]{3,}\n|\z)"
SENTENCE = r"(?s).*?(?:\n|(?<=[.!?])(?U:\s)+|\z)"
#: Fixed value: chunks up to this many times the maximum stay whole.
SLACK = 1.5

MIN, MAX = 500, 2000


def pieces(text: Column, pattern: str = PARAGRAPH) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: v != "")


def _state(out: Column, current: Column) -> Column:
    return F.struct(out.alias("out"), current.alias("current"))


def _empty() -> Column:
    return _state(F.array().cast("array<string>"), F.lit(""))


def _delimited(piece: Column) -> Column:
    return piece.rlike(r"(?s)(?:\n\n|\n[-=*]{3,}\n)\z")


def _pack(parts: Column, least: int, most: int, flush: bool) -> Column:
    """flush: also close a chunk at a delimiter once it is long enough."""

    def step(s: Column, piece: Column) -> Column:
        long, size = F.length(s["current"]) >= least, F.length(s["current"]) + F.length(piece)
        joined = F.concat(s["current"], piece)
        over = (size > most) & long
        added = _state(s["out"], joined)
        if flush:
            full = (size >= least) & _delimited(piece)
            added = F.when(full, _state(F.array_append(s["out"], joined), F.lit(""))).otherwise(added)
        return F.when(over, _state(F.array_append(s["out"], s["current"]), piece)).otherwise(added)

    return F.aggregate(parts, _empty(), step)


def _with_tail(s: Column, least: int, limit: float) -> Column:
    """The chunks with what is left: a short rest joins the chunk before it if that stays in bounds."""
    out, rest = s["out"], s["current"]
    last = F.element_at(out, -1)
    fits = (F.length(rest) < least) & (F.size(out) > 0) & (F.length(F.coalesce(F.get(out, F.size(out) - 1), F.lit(""))) + F.length(rest) <= limit)
    merged = F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.concat(last, rest))
    return F.when(rest == "", out).when(fits, merged).otherwise(F.array_append(out, rest))


def split_text(text: Column, least: int = MIN, most: int = MAX) -> Column:
    """The chunks of a text, an array of strings; empty for the empty text."""
    limit = SLACK * most
    packed = F.transform(F.array(_pack(pieces(text), least, most, True)), lambda s: _with_tail(s, least, limit))[0]

    def again(chunk: Column) -> Column:
        parts = F.transform(F.array(_pack(pieces(chunk, SENTENCE), least, most, False)), lambda s: F.when(s["current"] == "", s["out"]).otherwise(F.array_append(s["out"], s["current"])))[0]
        return F.when(F.length(chunk) > limit, parts).otherwise(F.array(chunk))

    return F.flatten(F.transform(packed, again))


def joined(chunks: Column) -> Column:
    return F.array_join(chunks, "")


def oversized(chunk: Column, most: int = MAX) -> Column:
    """A chunk without a break can stay longer than the slack allows."""
    return F.length(chunk) > SLACK * most
