"""Main-text extraction from HTML with a recurrent block labeller.

A page becomes its sequence of leaf blocks: stretches of text between block-level tags, with
the tags above them.  A bidirectional LSTM in numpy reads, for each block, the sum of
hashed vectors of its tag path (tags, words of class, id and role), the mean of hashed
word vectors, and a few counts, and labels it article or not in the context of the whole
page.  The weights are fitted by ``html_train`` to generated pages and kept beside this
module.

Comments, scripts, styles and other content that is never shown are no blocks; what follows
an element of the latter kind that is self-closed or never ends is read.  Character
references are decoded, white space inside a block (``<br>`` too) becomes one space, and
the article's blocks are joined by a line feed.

Nulls and pages without article: the empty text.  Unclosed, misnested and cut-off markup is
read as far as it goes; one look at each character, so a page's time and memory grow with its
length.  Equal pages, and repeated rows, give equal texts; there are no ties.  An empty table
gives an empty result, and columns named as those added are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .frames import add_columns, field

#: Hash buckets and widths of path and word vectors; width of each direction's state.
BUCKETS, PATH, WORD, STATE = 2048, 24, 8, 24
#: Blocks, with padding, that are labelled together.
CELLS = 1 << 14
WEIGHTS = Path(__file__).with_name("html_weights.npz")

BLOCKS = frozenset(
    "html head title body div section article main header footer nav aside ul ol li dl dt dd table caption thead tbody "
    "tfoot tr td th form fieldset legend p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption details summary address "
    "button label select option textarea dialog hgroup center noscript menu search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends open ones of these kinds, up to the nearest container.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "body": ("head title", ()),
}
#: A tag; quoted values may hold its end.  Possessive, so a tag that never ends is given up after one look.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
OTHER = re.compile(r"<[!?/][^>]*+>")
#: Elements whose content is no markup, and their ends.
RAW_ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "iframe")}
#: Elements whose content is skipped if they end.
UNSEEN = frozenset("template svg object audio video".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


_marks: dict[tuple[str, str], tuple[str, ...]] = {}


def marks(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag's tokens: its name and the words of its class, id and role."""
    key = (tag, attributes)
    if key not in _marks:
        if len(_marks) > 50_000:
            _marks.clear()
        words = []
        for name, value in ATTRIBUTE.findall(attributes):
            words += [f"{name.lower()}"] if not value or "hidden" in name.lower() else [f".{p.lower()}" for p in PIECE.findall(value)]
        _marks[key] = (tag, *dict.fromkeys(words))
    return _marks[key]


def tokens(page: str) -> list[tuple[str | None, str, str, str]]:
    """(text, closing, tag, attributes): stretches of text (tag empty) and tags (text None) in order.

    The time grows with the page's length: where a tag's quotes run to the end of the page without its end, quotes
    are no longer heeded on that page.
    """
    out: list[tuple[str | None, str, str, str]] = []
    here, last, quotes = 0, page.rfind(">"), True
    while 0 <= (at := page.find("<", here)) < last:
        if at > here:
            out.append((page[here:at], "", "", ""))
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            if end < 0:
                return out
            here = end + 3
            continue
        m = TAG.match(page, at) if quotes else None
        if not m and (m := PLAIN_TAG.match(page, at)):
            quotes = False
        if m:
            tag, here = m.group(2).lower(), m.end()
            if tag in RAW_ENDS and not m.group(1):
                if not (end_tag := RAW_ENDS[tag].search(page, here)):
                    return out
                here = end_tag.end()
            else:
                out.append((None, m.group(1), tag, m.group(3)))
        elif m := OTHER.match(page, at):
            here = m.end()
        else:
            out.append(("<", "", "", ""))
            here = at + 1
    rest = page[here:].split("<!--", 1)[0]  # nothing ends any more
    cut = rest.rfind("<")
    if cut >= 0 and re.match(r"[/!?a-zA-Z]", rest[cut + 1 : cut + 2]):
        rest = rest[:cut]
    return [*out, (rest, "", "", "")] if rest else out


def unseen(found: list[tuple[str | None, str, str, str]]) -> dict[int, int]:
    """Where each element of UNSEEN that ends starts, and its end; start and end tags of a name pair up from the inside."""
    ends: dict[int, int] = {}
    starts: dict[str, list[int]] = {}
    for i, (_, closing, tag, attributes) in enumerate(found):
        if tag not in UNSEEN:
            continue
        if not closing:
            if tag != "svg" or not attributes.endswith("/"):  # only foreign elements can be self-closed
                starts.setdefault(tag, []).append(i)
        elif starts.get(tag):
            ends[starts[tag].pop()] = i
    return ends


#: Elements around a block that the labeller reads, from the inside.
DEEPEST = 64


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()  # the tags of the stack
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(m for _, ms in stack[-DEEPEST:] for m in ms), min(linked, len(text))))
            parts.clear()
        linked = 0

    def cut(at: int) -> None:
        for tag, _ in stack[at:]:
            opened[tag] -= 1
        del stack[at:]

    def close(names: str, until: tuple[str, ...]) -> None:
        kinds = names.split()
        if not any(opened[k] > 0 for k in kinds):
            return
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in until:
                return
            if stack[at][0] in kinds:
                return cut(at)

    found = tokens(page)
    ends: dict[int, int] | None = None
    here = -1
    for i, (text, closing, tag, attributes) in enumerate(found):
        if i <= here:
            continue
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        if tag in UNSEEN and not closing:
            ends = unseen(found) if ends is None else ends
            here = ends.get(i, here)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag in ("br", "hr", "wbr"):
            if tag != "wbr":
                parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if closing:
                close(" ".join(HEADINGS) if tag in HEADINGS else tag, ())  # any heading's end ends a heading
            else:
                if tag not in ("button", "label", "select", "option", "textarea"):
                    close("p", ("button", "td", "th", "caption"))
                if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
                    cut(len(stack) - 1)
                if tag in ENDS:
                    close(*ENDS[tag])
                if not attributes.rstrip().endswith("/"):
                    stack.append((tag, marks(tag, attributes)))
                    opened[tag] += 1
            in_link = 0
    flush()
    return out


def _bucket(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h >> 20) % BUCKETS


_buckets: dict[str, int] = {}


def bucket(token: str) -> int:
    if token not in _buckets:
        if len(_buckets) > 50_000:
            _buckets.clear()
        _buckets[token] = _bucket(token)
    return _buckets[token]


COUNTS = 10


_LETTERS = vec.mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def word_buckets(w: vec.Words) -> np.ndarray:
    """Feature hashing, which the weights are fitted to: two words may well share a bucket."""
    size = 1 << max(4, int((w.ends - w.starts).max(initial=1)).bit_length())
    powers = np.array([pow(_BASE, i, 1 << 64) for i in range(min(size, 64))], dtype=np.uint64)
    length = np.minimum(w.ends - w.starts, len(powers))
    total = np.zeros(len(length), dtype=np.uint64)
    for i in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > i)
        total[live] += _LETTERS[w.data[w.starts[live] + i]] * powers[i]
    return ((vec.mix(total + (w.ends - w.starts).astype(np.uint64)) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


class Inputs:
    """What the labeller reads: of all blocks of some pages, one after the other."""

    def __init__(self, pages: list[list[Block]]):
        every = [b for p in pages for b in p]
        self.sizes = np.array([len(p) for p in pages], dtype=np.int64)
        n = len(every)
        self.path_ids = np.array([bucket(t) for b in every for t in b.path] or [0], dtype=np.int64)
        self.path_sizes = np.array([len(b.path) for b in every], dtype=np.int64)
        texts = [b.text for b in every]
        w = vec.words_of(pa.array([t.lower() for t in texts], pa.large_string()))
        self.word_ids = word_buckets(w)
        self.word_sizes = np.diff(w.first)
        length = np.array([len(t) for t in texts], dtype=float)
        closed = np.array([t[-1] in ".!?\"'”»" for t in texts], dtype=float)
        commas = np.array([t.count(",") + t.count(".") for t in texts], dtype=float)
        place = np.concatenate([np.arange(s) for s in self.sizes]) if n else np.zeros(0)
        total = np.repeat(self.sizes, self.sizes)
        deep = self.path_sizes.astype(float)
        self.counts = np.stack([
            np.log1p(length) / 4, np.log1p(self.word_sizes) / 3, np.array([b.linked for b in every]) / np.maximum(length, 1), closed,
            commas / np.maximum(self.word_sizes, 1), place / np.maximum(total, 1), 1 / (1 + place), 1 / np.maximum(total - place, 1),
            np.minimum(deep, 20) / 10, np.log1p(total) / 4,
        ], axis=1) if n else np.zeros((0, COUNTS))


def _sums(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the vectors of each block."""
    out = np.zeros((len(sizes), table.shape[1]))
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        step = 1 << 18  # words of vectors at a time
        if len(ids) <= step:
            out[some] = np.add.reduceat(table[ids], starts, axis=0)
        else:
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for at in range(0, len(ids), step):
                who = owner[at : at + step]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                out[who[first]] += np.add.reduceat(table[ids[at : at + step]], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """Bidirectional LSTM over the blocks of a page."""

    SHAPES = {
        "path": (BUCKETS, PATH), "word": (BUCKETS, WORD), "forward": (PATH + WORD + COUNTS + STATE + 1, 4 * STATE),
        "backward": (PATH + WORD + COUNTS + STATE + 1, 4 * STATE), "out": (2 * STATE + PATH + 1,),
    }

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def load(cls) -> Labeller:
        with np.load(WEIGHTS) as f:
            return cls({k: f[k].astype(np.float64) for k in cls.SHAPES})

    def inputs(self, x: Inputs) -> np.ndarray:
        path = _sums(self.w["path"], x.path_ids if x.path_sizes.sum() else x.path_ids[:0], x.path_sizes)
        word = _sums(self.w["word"], x.word_ids, x.word_sizes) / np.maximum(x.word_sizes, 1)[:, None]
        return np.concatenate([path, word, x.counts], axis=1)

    def run(self, weights: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x [time, page, width]; states are held where mask is 0.  keep: what the gradient needs."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, STATE)), np.zeros((pages, STATE))
        wx, wh, bias = weights[: x.shape[2]], weights[x.shape[2] : -1], weights[-1]
        span, given = max(1, CELLS // pages), np.zeros((0, pages, 4 * STATE))
        out, kept = np.zeros((steps, pages, STATE)), []
        for t in range(steps):
            if t % span == 0:  # what the inputs give, so many steps at a time
                given = x[t : t + span] @ wx + bias
            z = given[t % span] + h @ wh
            gates = _sigmoid(z[:, : 3 * STATE])
            i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
            g = np.tanh(z[:, 3 * STATE :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            tanh = np.tanh(new_c)
            if keep:
                kept.append((h, c, i, f, o, g, tanh))
            c = np.where(m, new_c, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return (out, kept) if keep else out

    @staticmethod
    def padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x as [time, page, width], its mask, and each block's place in it."""
        steps, pages = int(sizes.max()), len(sizes)
        page = np.repeat(np.arange(pages), sizes)
        time = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out, mask = np.zeros((steps, pages, x.shape[1])), np.zeros((steps, pages), bool)
        out[time, page], mask[time, page] = x, True
        return out, mask, time * pages + page

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, its blocks' probabilities of being article."""
        result = [np.zeros(0)] * len(pages)
        order = [int(i) for i in np.argsort([len(p) for p in pages], kind="stable") if pages[i]]
        at = 0
        while at < len(order):
            to = at + 1  # pages padded to the longest of them hold CELLS blocks at most, unless it is one page
            while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= CELLS:
                to += 1
            own, at = order[at:to], to
            x = Inputs([pages[i] for i in own])
            flat = self.inputs(x)
            padded, mask, place = self.padded(flat, x.sizes)
            ahead = self.run(self.w["forward"], padded, mask).reshape(-1, STATE)[place]
            back = self.run(self.w["backward"], padded[::-1], mask[::-1])[::-1].reshape(-1, STATE)[place]
            score = np.concatenate([ahead, back, flat[:, :PATH], np.ones((len(flat), 1))], axis=1) @ self.w["out"]
            for i, p in zip(own, np.split(_sigmoid(score), np.cumsum(x.sizes)[:-1])):
                result[i] = p
        return result


def main_text(found: list[Block], p: np.ndarray) -> str:
    return "\n".join(b.text for b, good in zip(found, p >= 0.5) if good)


FIELDS = [field("text", T.StringType()), field("n_chars", T.LongType())]


def extract(pages: DataFrame, html: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """``pages`` with text (the article's blocks) and n_chars; columns of these names are replaced."""
    model = labeller or Labeller.load()
    sent = pages.sparkSession.sparkContext.broadcast(model)  # below 1 MB, whatever the input

    def make():
        net = sent.value

        def work(part: pa.RecordBatch) -> list:
            column = part.column(part.schema.get_field_index("_html"))
            found = [blocks(page or "") for page in column.to_pylist()]
            texts = [main_text(b, p) for b, p in zip(found, net.label(found))]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    rows = pages.withColumn("_html", F.col(html))
    return add_columns(rows, make, FIELDS, "_html", keep=pages.columns)
