"""Command line: python -m rankloom.cli {file,folder,decompress,windows,chunks,resources} ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import client
from rankloom.functions.splitter import split_text
from rankloom.operators import rankcoder, reports
from rankloom.plans import compress, folder
from rankloom.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("file", "folder", "decompress", "windows", "chunks"):
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        if name != "decompress":
            c.add_argument("--debug", action="store_true")
        if name in ("file", "folder"):
            c.add_argument("--window-size", type=int, default=64)
            c.add_argument("--min-chunk", type=int, default=100)
            c.add_argument("--max-chunk", type=int, default=500)
            c.add_argument("--model", help="folder of a fitted model; else one is fitted to the input and kept in OUTPUT/Model")
            c.add_argument("--k", type=int, default=64)
            c.add_argument("--output", default="Output")
        elif name == "decompress":
            c.add_argument("--model", required=True)
            c.add_argument("--output", default="Output")
            c.add_argument("--strict", action="store_true")
        elif name == "windows":
            c.add_argument("--start-size", type=int, default=20)
            c.add_argument("--num-tests", type=int, default=10)
            c.add_argument("--increment", type=int, default=16)
        else:
            c.add_argument("--min", type=int, default=50)
            c.add_argument("--max", type=int, default=300)
            c.add_argument("--window", type=int, default=64)
            c.add_argument("--tokenize", action="store_true")
            c.add_argument("--output")
    c = sub.add_parser("resources")
    c.add_argument("--strict", action="store_true", help="fail without any")
    return p


def shown(table: DataFrame) -> None:
    """All rows of a report, however many, without holding them."""
    columns = table.columns
    print(" | ".join(columns))
    for row in table.toLocalIterator():
        print(" | ".join("" if row[c] is None else str(row[c]) for c in columns))


def chunks(a: argparse.Namespace, docs: DataFrame) -> None:
    shown(reports.integrity(docs, a.min, a.max))
    rows = rankcoder.chunk_rows(docs, a.min, a.max)
    shown(reports.chunk_stats(rows, "doc_id"))
    if a.tokenize:
        model = compress.Model.fit(docs, least=a.min, most=a.max)
        tokens = rankcoder.token_rows(rows).groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n"))
        shown(tokens.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.avg("n").alias("mean_tokens")))
        back = compress.decompress(compress.compress(docs, model, a.window, a.min, a.max), model).withColumnRenamed("text", "back")
        shown(docs.join(back, "doc_id").select("file_name", (F.col("text") == F.col("back")).alias("identical")))
    if a.output:
        whole = docs.select("file_name", F.array_join(split_text(F.col("text"), a.min, a.max), "").alias("text"))
        files.write_files(whole, a.output, "file_name", "text")


def windows(a: argparse.Namespace, docs: DataFrame) -> None:
    model = compress.Model.fit(docs)
    sizes = [a.start_size + i * a.increment for i in range(a.num_tests)]
    table = compress.sweep(docs, model, sizes, timed=True)
    shown(reports.displayed(table.orderBy("window_size")))
    shown(reports.displayed(reports.best_window(table)))
    shown(reports.displayed(reports.fastest_window(table)))
    if a.debug:
        shown(reports.token_mix(compress.coded(docs, model, sizes[0])))


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "resources":
        found = client.resources(spark)
        print(found or "no accelerators")
        if a.strict and not found:
            sys.exit(1)
    elif a.command == "decompress":
        shown(folder.decompress(spark, a.input, a.output, compress.Model.load(spark, a.model), a.strict))
    elif a.command == "chunks":
        chunks(a, folder.documents(spark, a.input))
    elif a.command == "windows":
        windows(a, folder.documents(spark, a.input))
    else:
        if a.model:
            model = compress.Model.load(spark, a.model)
        else:
            model = compress.Model.fit(folder.documents(spark, a.input), k=a.k)
            model.save(f"{a.output}/Model")
        told = folder.run(spark, a.input, a.output, model, a.window_size, a.min_chunk, a.max_chunk, debug=a.debug)
        shown(reports.displayed(told))
        shown(reports.displayed(reports.corpus(told)))


if __name__ == "__main__":
    main()
