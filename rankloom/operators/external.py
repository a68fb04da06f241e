"""The same coder for a model that is not a table: anything with ``tokenize``, ``detokenize`` and ``top_k``.

``load`` makes the model; it runs once in each Python worker, on first use.  Positions of a chunk
are coded from the tokens before them, so all contexts of a batch of chunks go to the model at
once; decoding asks for one place of every chunk of the batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.functions import codec
from rankloom.operators.rankcoder import RankModel

class NextPoints:
    """A model without any table: ids are code points, and the candidates are the last one and those after it."""

    def tokenize(self, text: str) -> list[int]:
        return [ord(c) for c in text]

    def detokenize(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))

    def top_k(self, contexts: list[list[int]]) -> list[range]:
        return [range(c[-1], c[-1] + codec.RANKS) for c in contexts]


_models: dict[Callable, RankModel] = {}


def loaded(load: Callable[[], RankModel]) -> RankModel:
    """The worker's model: made on first use."""
    if load not in _models:
        _models[load] = load()
    return _models[load]


#: Chunks whose places go to the model together.
BATCH = 64


def encoded(texts: list[str], model: RankModel, window: int = codec.WINDOW) -> list[list[tuple[str, int]]]:
    ids = [model.tokenize(t) for t in texts]
    places = [(i, p) for i, own in enumerate(ids) for p in range(1, len(own))]
    told = model.top_k([ids[i][max(0, p - window) : p] for i, p in places]) if places else []
    out = [[(codec.EXPLICIT, x) for x in own[:1]] for own in ids]
    for (i, p), candidates in zip(places, told):
        best = (candidates if isinstance(candidates, range) else list(candidates))[: codec.RANKS]  # a range is not spread out
        x = ids[i][p]
        out[i].append((codec.RANK, best.index(x)) if x in best else (codec.EXPLICIT, x))
    return out


def decoded(chunks: list[list[tuple[str, int]]], model: RankModel, window: int = codec.WINDOW) -> list[str]:
    ids: list[list[int]] = [[] for _ in chunks]
    for place in range(max(map(len, chunks), default=0)):
        asked = [i for i, c in enumerate(chunks) if place < len(c) and c[place][0] == codec.RANK]
        told = dict(zip(asked, model.top_k([ids[i][max(0, place - window) :] for i in asked]))) if asked else {}
        for i, c in enumerate(chunks):
            if place < len(c):
                ids[i].append(int(told[i][c[place][1]]) if i in told else c[place][1])
    return [model.detokenize(x) for x in ids]


def tokenize_chunks(chunks: DataFrame, load: Callable[[], RankModel], window: int = codec.WINDOW) -> DataFrame:
    """``chunks`` (with a column chunk) and tokens: array of (kind, value)."""
    names = chunks.columns

    def run(batches):
        model = loaded(load)
        for batch in batches:
            for part in (batch.slice(at, BATCH) for at in range(0, batch.num_rows, BATCH)):
                made = encoded([t or "" for t in part.column(names.index("chunk")).to_pylist()], model, window)
                flat = [t for c in made for t in c]
                tokens = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.int32())], ["kind", "value"])
                ends = pa.array([0, *accumulate(map(len, made))], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, tokens)], [*names, "tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{kinds}, tokens array<{codec.TOKEN}>")


def detokenize_chunks(rows: DataFrame, load: Callable[[], RankModel], window: int = codec.WINDOW) -> DataFrame:
    """``rows`` (with a column tokens) and text."""
    names = rows.columns

    def run(batches):
        model = loaded(load)
        for batch in batches:
            for part in (batch.slice(at, BATCH) for at in range(0, batch.num_rows, BATCH)):
                lists = part.column(names.index("tokens"))
                flat, ends = lists.flatten(), [0, *accumulate(lists.value_lengths().fill_null(0).to_pylist())]
                pairs = list(zip(flat.field("kind").to_pylist(), flat.field("value").to_pylist()))
                own = [pairs[a:b] for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded(own, model, window), pa.string())], [*names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, text string")
