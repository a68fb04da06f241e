"""A corpus made ready for training: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a frame; what it returns is written as
Parquet and read again as the next one's documents.  All but the last return the columns of
``documents``.

Nulls and empty texts pass all stages: the classifier scores them as empty texts, they have no
lines, are near copies of nothing, hit nothing, and have no pieces.  Rows equal in id and text
are one document to the line and near-duplicate stages, and one of them stays.  Extra columns
are kept whatever their names.  Empty tables give empty results; without labels every document
scores one half and stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontaminate, jaccard, lines, pieces, quality
from rankloom.llm.frames import own_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, all but their first copy; a document that loses all its lines goes with them."""
    return lines.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids: doc_id, n_tokens and ids."""
    made = pieces.encode(docs)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The quality classifier, boosted trees, has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
