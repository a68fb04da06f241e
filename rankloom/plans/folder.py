"""Folders of files: compressed, decompressed, compared and reported."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import codec
from rankloom.operators import packed, rankcoder, reports
from rankloom.plans import compress
from rankloom.sources import files
from rankloom.sources.tables import drop_path


def documents(spark: SparkSession, path: str | list[str], utf8_only: bool = False) -> DataFrame:
    """The files as documents; doc_id is a hash of the path."""
    return files.scan_texts(spark, path, utf8_only=utf8_only).withColumn("doc_id", F.xxhash64("path"))


def run(
    spark: SparkSession, source: str | list[str], output: str, model: compress.Model, window: int = codec.WINDOW,
    least: int = compress.LEAST, most: int = compress.MOST, utf8_only: bool = False, debug: bool = False,
) -> DataFrame:
    """Writes Compressed/*.bin and Results/* (with ``debug`` also Debug/*) below ``output``; the report of each file.

    A file that can't be decoded, or whose payload can't, is a row with an error and has no output.  Files are read, coded,
    compared and written in blocks, so none is held as a whole; ``debug`` is for files that a task can hold.
    """
    began = time.time()
    rows = compress.payload_table(files.scan_blocks(spark, source, least, most, utf8_only), model, window, least, most)
    told = compress.checked(rows, model, window, least, most, time.time() - began)
    out = files.output_dirs(spark, output, debug)
    body = F.when(F.col("no") == 0, F.col("payload")).otherwise(F.expr(f"substring(payload, {len(packed.head(window)) + 1})"))
    files.write_parts(rows.where("error is null").select("doc_id", "file_name", "no", body.alias("part"), F.lit(b"\xff").alias("between"), "error"), out["compressed"], ".bin")
    drop_path(spark, rows.inputFiles()[0].rsplit("/", 1)[0])  # the report has what it needs of the texts
    decompress(spark, out["compressed"], out["results"], model)
    if debug:
        docs = documents(spark, source, utf8_only)
        files.write_files(docs, out["debug"], "file_name", "content", ".original")
        names = docs.select("doc_id", "file_name")
        streams = compress.token_streams(docs, model, window, least, most).where("stream is not null")
        files.write_files(reports.token_dumps(streams).join(names, "doc_id"), out["debug"], "file_name", "dump", ".tokens.txt")
        payloads = files.scan_payloads(spark, out["compressed"]).join(names, "file_name")
        back = payloads.select("doc_id", codec.decode(F.col("payload"))["tokens"].alias("stream"))
        files.write_files(reports.token_comparisons(streams, back).join(names, "doc_id"), out["debug"], "file_name", "comparison", ".comparison.txt")
    return told


def decompress(spark: SparkSession, source: str, output: str, model: compress.Model, strict: bool = False) -> DataFrame:
    """Writes the texts of a folder of .bin files; file_name and error of each."""
    made = rankcoder.decode_payloads(files.scan_payload_blocks(spark, source), model.store, model.k, strict)
    return files.write_parts(made.select("doc_id", "file_name", "no", F.col("back").alias("part"), F.lit(b"").alias("between"), F.col("back_error").alias("error")), output)
