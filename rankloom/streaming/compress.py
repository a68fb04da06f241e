"""Splitting and packing over a stream of documents.

A stream can't be windowed by position, so micro-batches go through the batch plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.functions import codec
from rankloom.functions.splitter import split_text
from rankloom.plans.compress import LEAST, MOST, Model, compress


def chunk_stream(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, chunk_no and chunk of a stream of documents: per row, without state."""
    return docs.select("doc_id", F.posexplode(split_text(F.col("text"), least, most)).alias("chunk_no", "chunk"))


def compress_stream(docs: DataFrame, model: Model, output: str, checkpoint: str, window: int = codec.WINDOW, available_now: bool = True) -> StreamingQuery:
    """Compresses each micro-batch into its own folder below ``output``: a batch that runs again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        compress(df, model, window).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
