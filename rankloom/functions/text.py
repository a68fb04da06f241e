"""Scalar rules on paths and texts, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types by extension.
FILE_TYPES = {
    "py": "python",
    "java": "java",
    "js": "java",
    "html": "html",
    "htm": "html",
    "md": "markdown",
    "json": "json",
    "xml": "xml",
    "txt": "general",
}

#: Where a piece of a file may end, for the splitter's optional mode: after these, and always after blank lines.
ENDINGS = {
    "python": r"\n(?:return|pass|raise)\b[^\n]*\n|:[ \t]*\n",
    "java": r"[;{}][ \t]*\n",
    "html": r"</[a-z][a-z0-9]*>[ \t]*\n?|-->",
    "markdown": r"\n#+ [^\n]*\n|\n[-+*] [^\n]*",
    "json": r"[,\[{}\]][ \t]*\n",
    "xml": r"/>|</[^<>]*>",
    "general": r"[.!?][ \t]*\n",
}


def typed_pieces(text: Column, kind: str) -> Column:
    """An option beside the general splitter: pieces that end where a file of this type has a natural end.  Joined they are the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:\n\n|{ENDINGS[kind]}|\z)"), F.lit(0)), lambda v: v != "")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The extension in lower case without its dot; leading dots of a name begin no extension.

    A path without one but with a dot somewhere gives what follows its last dot.
    """
    name = F.regexp_replace(base_name(path), r"^\.+", "")
    own = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.lower(F.when(name.contains("."), own).otherwise(F.regexp_extract(path, r"\.([^.]*)$", 1)))


def file_type(path: Column) -> Column:
    types = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(types, extension(path)), F.lit("general"))


def strip_url(url: Column) -> Column:
    """A URL without query and fragment."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 if all of them are valid, else all as Latin-1."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))


def encoding_of(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("latin-1")


def newlines(text: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def ratio(original: Column, compressed: Column) -> Column:
    return F.when(compressed > 0, original / compressed).otherwise(F.lit(0.0))


def savings(original: Column, compressed: Column) -> Column:
    """Percent saved; null for an empty original."""
    return (1 - compressed / F.nullif(original, F.lit(0))) * 100


def same_text(a: Column, b: Column) -> Column:
    """Equality of two contents as bytes, or as text with newlines normalised."""
    text = lambda c: newlines(F.make_valid_utf8(c.cast("string")))
    return F.coalesce((a == b) | (text(a) == text(b)), F.lit(False))


def first_difference(a: Column, b: Column) -> Column:
    """The first place (from 0) where two texts differ; null for equal ones.

    The common beginning is found by halves, so a text of any length needs no list of its characters.  As variables
    of a function both are made once.
    """

    def common(p: Column) -> Column:
        same = lambda at, step: (at + step <= p["n"]) & (F.substring(p["a"], (at + 1).cast("int"), step.cast("int")) == F.substring(p["b"], (at + 1).cast("int"), step.cast("int")))
        steps = F.array(*(F.lit(1 << i).cast("long") for i in range(30, -1, -1)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda at, step: F.when(same(at, step), at + step).otherwise(at))

    both = F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n"))
    return F.when(a != b, F.transform(F.array(both), common)[0])
