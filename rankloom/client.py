"""Single texts and token lists, for callers without a table of their own; each call is a small Spark job.

The forms for tables, which a corpus needs, are in ``plans.compress`` and ``operators``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import codec
from rankloom.operators import rankcoder
from rankloom.plans.compress import Model

Token = tuple[str, int]


def _spark(model: Model) -> SparkSession:
    return model.vocab.sparkSession


def tokenize_chunks(model: Model, texts: list[str], window: int = codec.WINDOW) -> list[list[Token]]:
    """The coded tokens of each text, taken as one chunk."""
    rows = _spark(model).createDataFrame([(i, [t]) for i, t in enumerate(texts)], "doc_id long, chunks array<string>")
    out: list[list[Token]] = [[] for _ in texts]
    for r in rankcoder.encode_rows(rows, model.store, window, model.k, model.how).orderBy("doc_id", "pos").collect():
        out[r["doc_id"]].append((r["kind"], r["value"]))
    return out


def detokenize_chunks(model: Model, chunks: list[list[Token]], window: int = codec.WINDOW) -> list[str]:
    """The inverse; raises for tokens that the model can't have made."""
    rows = _spark(model).createDataFrame([(i, window, c) for i, c in enumerate(chunks)], f"doc_id long, window int, stream array<{codec.TOKEN}>")
    out = [""] * len(chunks)
    for r in rankcoder.decode_streams(rows, model.store, model.k).collect():
        if r["error"]:
            raise ValueError(r["error"])
        out[r["doc_id"]] = "".join(r["chunks"])
    return out


def tokenize(model: Model, text: str, window: int = codec.WINDOW) -> list[Token]:
    return tokenize_chunks(model, [text], window)[0]


def detokenize(model: Model, tokens: list[Token], window: int = codec.WINDOW) -> str:
    return detokenize_chunks(model, [tokens], window)[0]


def predict_next_words(model: Model, text: str, k: int = rankcoder.CANDIDATES) -> list[str]:
    """The k likeliest tokens after a text."""
    ids = [i for r in rankcoder.word_ids(_words(model, text), model.vocab).orderBy("pos").collect() for i in r["ids"]]
    best = list(dict.fromkeys(rankcoder.likeliest(ids, model.store, model.k)))[:k]
    return rankcoder.spelt(np.array(best, np.int64), model.store)


def _words(model: Model, text: str) -> DataFrame:
    row = _spark(model).createDataFrame([(text,)], "text string")
    return row.select(F.posexplode(rankcoder.tokenize(F.col("text"), model.how)).alias("pos", "word"))


def token_ids(model: Model, word: str) -> list[int]:
    """The ids of a word."""
    return [i for r in rankcoder.word_ids(_words(model, word), model.vocab).orderBy("pos").collect() for i in r["ids"]]


def word_of(model: Model, ids: int | list[int]) -> str:
    """What one id or several stand for."""
    rows = _spark(model).createDataFrame(list(enumerate([ids] if isinstance(ids, int) else ids)), "pos int, token_id int")
    return "".join(r["word"] for r in rankcoder.id_words(rows, model.vocab).orderBy("pos").collect())


def resources(spark: SparkSession) -> dict[str, list[str]]:
    """Accelerators that Spark has found for the driver, and what it asks for each executor: name to addresses."""
    found = {name: list(info.addresses) for name, info in spark.sparkContext.resources.items()}
    for k, v in spark.sparkContext.getConf().getAll():
        if k.startswith("spark.executor.resource.") and k.endswith(".amount"):
            found.setdefault(k.split(".")[3], []).append(f"{v} an executor")
    return found


def register_functions(spark: SparkSession, model: Model | None = None) -> None:
    """Table functions for SQL: ``rank_units(payload)`` and, with a model, ``rank_next(word)``; use them after LATERAL."""
    units = codec.BYTES.replace("'", "''")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION rank_units(payload BINARY) RETURNS TABLE (pos INT, unit STRING) "
        f"RETURN SELECT u.pos, u.col FROM (SELECT posexplode(regexp_extract_all(hex(payload), '{units}', 0))) AS u(pos, col)"
    )
    if model is not None:
        listed = rankcoder.next_words(model.vocab.select("token"), model.vocab, model.ranks).select("token", "rank", "next")
        listed.createOrReplaceTempView("rank_next_words")
        spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION rank_next(word STRING) RETURNS TABLE (rank INT, next STRING) "
            "RETURN SELECT w.rank, w.next FROM rank_next_words AS w WHERE w.token = word"
        )
