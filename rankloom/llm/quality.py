"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (``FEATURES``) come from its bytes, words and lines with numpy; labels,
language, source and id are no inputs.  Trees of a fixed depth are fitted on the driver to
at most ``SAMPLE`` labelled rows, chosen by the hash of their id; everything else sees
all rows.  A tree is a heap-ordered row of two arrays (feature, threshold), so all rows of
a slice descend together, one numpy step for each level.

Nulls: a null text counts as empty; empty texts get a score too.  Labels that are null are
left out, several labels of a document are averaged; of several texts with one id the one with the
least statistics is learnt from.  With labels of one kind or none the score is their smoothed share.
Equal texts get equal scores; a tie, 0.5, counts as good.  A text of any length is read whole.  An
empty table gives an empty result, and columns named as those added are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .frames import add_columns, field

#: Labelled rows that the trees are fitted to, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 120, 5, 64, 0.1, 1.0, 5.0

_CLASS = np.zeros(256, dtype=np.uint8)  # 0: other symbols
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[32], _CLASS[10] = 4, 5
_CLASS[[44, 46, 59, 58]] = 6  # , . ; :
_CLASS[[33, 63]] = 7  # ! ?
_CLASS[128:] = 8
_CLASS[124] = 9  # |

FEATURES = [
    "log_bytes", "upper", "lower", "digits", "spaces", "newlines", "points", "marks", "high", "bars", "symbols",
    "log_words", "word_mean", "word_std", "short_words", "long_words", "capital_words", "caps_words", "odd_ends", "odd_words",
    "distinct_words", "top_word", "distinct_pairs", "words_a_line", "lines_closed", "distinct_lines", "log_lines", "entropy",
]


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and the count of its most frequent one."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    both = vec.mix(keys.astype(np.uint64) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, counts = np.unique(both, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, rows[at], counts)
    return np.bincount(rows[at], minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES (float64) for each text."""
    data, offsets = vec.flat(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10)
    bytes_ = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    p = bytes_ / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    w = vec.words_of(column)
    of, words = w.row_of(), np.diff(w.first)
    length = w.ends - w.starts
    mean = _share(np.bincount(of, length, n), words)
    std = np.sqrt(np.maximum(_share(np.bincount(of, length.astype(float) ** 2, n), words) - mean**2, 0))
    kind = _CLASS[w.data]
    tail, head = kind[w.ends - 1], kind[w.starts]
    count = lambda mask: _share(np.bincount(of, mask, n), words)
    symbol, upper, lower = (np.r_[0, np.cumsum(kind == k)] for k in (0, 1, 2))
    within = lambda total: total[w.ends] - total[w.starts]
    caps = (within(upper) > 1) & (within(lower) == 0)
    different, most = _distinct(of, w.hashes, n)
    pairs = vec.gram_hashes(w.hashes, 2)
    inside = of[1:] == of[:-1] if len(of) else np.zeros(0, bool)
    pairs_different, _ = _distinct(of[:-1][inside], pairs[inside] if len(pairs) else pairs, n)

    lines = vec.words_of(column, vec.byte_table(b"\n"))
    line_of, n_lines = lines.row_of(), np.diff(lines.first)
    lines_different, _ = _distinct(line_of, lines.hashes, n)
    closed = np.isin(lines.data[lines.ends - 1], [33, 46, 63])
    columns = [
        np.log1p(size), *(_share(kinds[:, k], size) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 0)),
        np.log1p(words), mean, std, count(length <= 2), count(length >= 12), count(head == 1), count(caps),
        count((tail == 0) | (tail == 7)), count(within(symbol) > 0),
        _share(different, words), _share(most, words), _share(pairs_different, words - 1), _share(words, n_lines),
        _share(np.bincount(line_of, closed, n), n_lines), _share(lines_different, n_lines), np.log1p(n_lines), entropy,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # int32 [trees, 2**depth - 1]
    threshold: np.ndarray  # float64, the same; a row goes right if its value is greater
    leaf: np.ndarray  # float64 [trees, 2**depth]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)] if node.size else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Newton boosting of the logistic loss; all nodes of a level are split from one histogram."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)))
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    offset = binned + np.arange(width) * BINS
    raw, out = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            n, first = 2**level, 2**level - 1
            slot = (node[:, None] * (width * BINS) + offset).ravel()
            sums = [np.bincount(slot, np.repeat(v, width), n * width * BINS).reshape(n, width, BINS).cumsum(2) for v in (g, h)]
            left_g, left_h = sums
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
            gain[(left_h < LEAST / 4) | (right_h < LEAST / 4)] = -1
            best = gain.reshape(n, -1).argmax(1)
            good = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            f, b = best // BINS, best % BINS
            for i in np.flatnonzero(good):
                if b[i] < len(cuts[f[i]]):
                    feature[first + i], threshold[first + i] = f[i], cuts[f[i]][b[i]]
            node = 2 * node + (x[np.arange(len(x)), feature[first + node]] > threshold[first + node])
        leaf = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + L2) * RATE
        raw = raw + leaf[node]
        for kept, made in zip(out, (feature, threshold, leaf)):
            kept.append(made)
    return Forest(base, *(np.stack(v) for v in out))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = SAMPLE) -> Forest:
    """Fits to labelled rows outside the held-out third, at most ``most``."""
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_mark"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    chosen = docs.select("doc_id", text).join(F.broadcast(marked), "doc_id")  # bounded by ``most``

    def make():
        return lambda part: [pa.array(list(statistics(part.column(part.schema.get_field_index(text)))), pa.list_(pa.float64()))]

    rows = add_columns(chosen, make, [field("_x", T.ArrayType(T.DoubleType()))], text, keep=["doc_id", "_mark"])
    one = rows.groupBy("doc_id", "_mark").agg(F.min("_x").alias("_x"))  # of rows with the same id one, so ``most`` rows at most
    got = one.toPandas().sort_values("doc_id")
    x = np.array(got["_x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["_mark"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (0 or 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # some 100 KB, whatever the input

    def make():
        model = sent.value

        def work(part: pa.RecordBatch) -> list:
            s = model.score(statistics(part.column(part.schema.get_field_index(text))))
            return [s, (s >= 0.5).astype(np.int32)]

        return work

    return add_columns(docs, make, [field("score", T.DoubleType()), field("predicted", T.IntegerType())], text)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with predicted = 1, with their own columns."""
    own = docs.columns
    spare = {c: f"_kept_{c}" for c in own if c in ("score", "predicted")}
    scored = score(docs.withColumnsRenamed(spare), train(docs, labels))
    return scored.where("predicted = 1").select(*[F.col(spare.get(c, c)).alias(c) for c in own])
