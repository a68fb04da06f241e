"""The whole way: texts to payloads and back, reports and the window sweep."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import codec
from rankloom.functions import text as rules
from rankloom.operators import packed, rankcoder, reports
from rankloom.operators.store import Store, build_lists, build_words
from rankloom.sources.tables import own_dir, written

LEAST, MOST = 100, 500


@dataclass
class Model:
    """A vocabulary and a table of candidates, fitted to declared texts; kept as Parquet and as a store with its name beside each payload."""

    name: str
    vocab: DataFrame
    ranks: DataFrame
    path: str
    how: str = "words"
    k: int = rankcoder.CANDIDATES
    _store: Store | None = None

    @classmethod
    def fit(
        cls, docs: DataFrame, name: str = "model", how: str = "words", least: int = LEAST, most: int = MOST, k: int = rankcoder.CANDIDATES,
        most_tokens: int | None = None, most_ranks: int | None = None, path: str | None = None,
    ) -> Model:
        """All of the texts' tokens and lists, below ``path``.  With ``most_tokens`` and ``most_ranks`` what is left out is coded by explicit ids."""
        spark = docs.sparkSession
        path = path or f"{own_dir(spark)}/model-{uuid.uuid4().hex}"
        rankcoder.vocabulary(rankcoder.word_counts(docs, how, (least, most)), most_tokens).write.parquet(f"{path}/vocabulary")
        vocab = spark.read.parquet(f"{path}/vocabulary")
        build_words(vocab, f"{path}/store")
        sums = vocab.agg(F.count_if(F.col("n") >= rankcoder.LEAST).alias("frequent"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sums["tokens"] // rankcoder.BUCKET)
        grams = rankcoder.gram_rows(docs, Store.load(spark, f"{path}/store", lists=False), sums["frequent"], buckets, how, (least, most))
        rankcoder.rank_table(grams.unionByName(rankcoder.vocabulary_rows(vocab, buckets)), k, most=most_ranks, buckets=buckets).write.parquet(f"{path}/ranks")
        return cls(name, vocab, spark.read.parquet(f"{path}/ranks"), path, how, k)._finish(path)

    def _finish(self, path: str) -> Model:
        build_lists(self.ranks, f"{path}/store")
        self.vocab.sparkSession.createDataFrame([(self.name, self.how, self.k)], "name string, how string, k int").coalesce(1).write.parquet(f"{path}/about")
        return self

    def save(self, path: str) -> None:
        self.vocab.write.parquet(f"{path}/vocabulary")
        self.ranks.write.parquet(f"{path}/ranks")
        build_words(self.vocab, f"{path}/store")
        self._finish(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(about["name"], spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/ranks"), path, about["how"], about["k"])

    @property
    def store(self) -> Store:
        if self._store is None:
            self._store = Store.load(self.vocab.sparkSession, f"{self.path}/store")
        return self._store


def coded(docs: DataFrame, model: Model, window: int = codec.WINDOW, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, chunk_no, pos, kind and value."""
    return rankcoder.encode_rows(docs.select("doc_id", "text"), model.store, window, model.k, model.how, (least, most))


def token_streams(docs: DataFrame, model: Model, window: int = codec.WINDOW, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id and stream of every document: empty for an empty text, null for none."""
    return rankcoder.streams(docs, model.store, window, model.k, model.how, (least, most))


def compress(docs: DataFrame, model: Model, window: int = codec.WINDOW, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, window_size, model, payload, compressed_size and error of each document.

    An empty text is a header.  A document without text, as a file that can't be decoded, is a row with an error.
    """
    return _payloads(docs.select("doc_id", "text"), model, window, least, most).drop("text")


def _payloads(docs: DataFrame, model: Model, window: int, least: int, most: int) -> DataFrame:
    """``docs`` with the columns that ``compress`` adds."""
    made = rankcoder.encode_payloads(docs, model.store, window, model.k, model.how, (least, most))
    rows = made.select(*docs.columns, F.lit(window).alias("window_size"), F.lit(model.name).alias("model"), "payload")
    return rows.withColumn("compressed_size", F.octet_length("payload").cast("long")).withColumn("error", F.when(F.col("payload").isNull(), "no text"))


def decompress_chunks(payloads: DataFrame, model: Model, strict: bool = False) -> DataFrame:
    """doc_id, chunks and error of payloads; the window comes from the header.

    strict: a stream without header, or cut off inside an id, is an error; else it is read as far as it goes.
    """
    return rankcoder.decode_payloads(payloads.select("doc_id", "payload"), model.store, model.k, strict, chunks=True).select("doc_id", F.col("back").alias("chunks"), F.col("back_error").alias("error"))


def decompress(payloads: DataFrame, model: Model, strict: bool = False) -> DataFrame:
    """doc_id, text and error of payloads."""
    return rankcoder.decode_payloads(payloads.select("doc_id", "payload"), model.store, model.k, strict).select("doc_id", F.col("back").alias("text"), F.col("back_error").alias("error"))


def round_trip(docs: DataFrame, model: Model, window: int = codec.WINDOW, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``docs`` with payload, back and back_error: texts packed and unpacked without writing or joining anything; the text is carried along."""
    made = rankcoder.encode_payloads(docs, model.store, window, model.k, model.how, (least, most))
    return rankcoder.decode_payloads(made, model.store, model.k)


def _original(docs: DataFrame) -> Column:
    """Bytes of the file where they are known, else of the text in UTF-8."""
    return (F.col("original_size") if "original_size" in docs.columns else F.octet_length("text")).cast("long").alias("original_size")


def sizes(docs: DataFrame, model: Model, window: int = codec.WINDOW, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, original_size and compressed_size with ratio and savings, without making bytes."""
    packed = token_streams(docs, model, window, least, most).select("doc_id", codec.packed_size(F.col("stream"), window).alias("compressed_size"))
    return reports.ratios(docs.select("doc_id", _original(docs)).join(packed, "doc_id"))


def report(docs: DataFrame, model: Model, window: int = codec.WINDOW, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row a document: sizes, ratio, identity of bytes, text and tokens, encoding, and an error instead of a failed job.

    Columns file_name, encoding, original_size and content of ``docs`` are used where they are there: a size is the
    file's, and ``identical_bytes`` compares its bytes.  Times are of the whole job.
    """
    began = time.time()
    payloads = payload_table(docs, model, window, least, most)
    return checked(payloads, model, window, least, most, time.time() - began)


def payload_table(docs: DataFrame, model: Model, window: int = codec.WINDOW, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The payloads beside the documents, or blocks of them (no), that they were made from, written."""
    names = [c for c in ("no", "file_name", "encoding", "plain", "content") if c in docs.columns]
    return written(_payloads(docs.select("doc_id", *names, _original(docs), "text"), model, window, least, most))


def checked(payloads: DataFrame, model: Model, window: int, least: int, most: int, compression_time: float) -> DataFrame:
    """The report of a ``payload_table``: each payload is decoded, and compared with the document in its row; nothing is joined.

    Of blocks (no, plain) the numbers of a document are added up at the end.
    """
    began = time.time()
    blocks = "no" in payloads.columns
    names = [c for c in ("no", "file_name", "encoding") if c in payloads.columns]
    raw = F.col("content") if "content" in payloads.columns else F.encode("text", "UTF-8")
    raw = F.when(F.col("plain"), raw) if "plain" in payloads.columns else raw
    out = F.encode("back", "UTF-8")
    told = rankcoder.decode_payloads(payloads, model.store, model.k, again=(window, model.how, (least, most)))
    rows = written(told.select(
        "doc_id", *names, "window_size", "original_size", "compressed_size",
        F.coalesce(raw == out, F.lit(False)).alias("identical_bytes"), F.coalesce(rules.same_text(F.encode("text", "UTF-8"), out), F.lit(False)).alias("identical"),
        "tokens_identical", F.coalesce("error", "back_error").alias("error"),
    ))
    rows = _whole(rows, window) if blocks else rows
    rows = rows.select(*rows.columns[:-1], F.lit(compression_time).alias("compression_time"), F.lit(time.time() - began).alias("decompression_time"), "error")
    return reports.ratios(rows)


def _whole(rows: DataFrame, window: int) -> DataFrame:
    """A row for each document from those of its blocks: a payload has one header, and a break between blocks."""
    same = ("identical_bytes", "identical", "tokens_identical")
    size = F.sum("compressed_size") - (F.count("*") - 1) * (len(packed.head(window)) - 1)
    error = F.min(F.when(F.col("error").isNotNull(), F.struct("no", "error")))["error"]
    return rows.groupBy("doc_id", "file_name", "encoding", "window_size", "original_size").agg(size.alias("compressed_size"), *(F.bool_and(c).alias(c) for c in same), error.alias("error"))


def sweep(docs: DataFrame, model: Model, windows: Sequence[int], least: int = LEAST, most: int = MOST, timed: bool = False) -> DataFrame:
    """Totals for each window size: sizes and ratios, and with ``timed`` also identity and seconds of both ways.

    Tokens are looked up once for all windows, and only sizes leave the tasks.  Seconds are those of tasks, added up; they are measured once,
    and the table is written.
    """
    if timed:
        rows = rankcoder.both_ways(docs.select(_original(docs), "text"), model.store, list(dict.fromkeys(windows)), model.k, model.how, (least, most))
        return written(reports.corpus(rows, "window_size", added=("compression_time", "decompression_time")))
    rows = docs.where("text is not null").select("doc_id", _original(docs), "text")
    sizes_ = rankcoder.body_sizes(rows, model.store, sorted({rankcoder.reach(w) for w in windows}), model.k, model.how, (least, most))
    each = F.filter(F.array(*map(F.lit, windows)), lambda w: F.least(w, F.lit(rankcoder.ORDER)) == F.col("reach"))
    packed = sizes_.select("original_size", "body_size", F.explode(each).alias("window_size"))
    head = codec.explicit_width(F.col("window_size").cast("long"))
    return reports.corpus(packed.select("window_size", "original_size", (F.col("body_size") + head).alias("compressed_size")), "window_size").drop("n_identical")
