"""What the operators share: reading, shared-folder tables, Arrow columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from rankloom.sources.tables import drop_path, own_dir

from . import vec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Stored:
    """A frame written to the shared folder and read back: its lineage ends there, and a lost executor loses nothing."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{own_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


def settled(df: DataFrame) -> DataFrame:
    """``df`` if it does no more than read files row by row, so that each walk sees the same rows in the same partitions; else written first."""

    def plain(node) -> bool:
        kids = node.children()
        if not kids.size():
            return node.nodeName() in ("LogicalRelation", "RelationV2", "DataSourceV2ScanRelation")
        return node.nodeName() in ("Project", "Filter") and all(plain(kids.apply(i)) for i in range(kids.size()))

    return df if plain(df._jdf.queryExecution().optimizedPlan()) else stored(df)


def add_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    fields: list[T.StructField],
    text: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns of ``df`` (or those in ``keep``) and new ones, made from slices of whole rows.

    ``make`` runs once in each task and returns the function for a slice.  A new column
    takes the place of one of the same name.
    """
    new = {f.name for f in fields}
    old = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in old]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    labels = names + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in vec.slices(batch, text):
                own = [part.column(part.schema.get_field_index(n)) for n in names]
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(work(part), kinds)]
                yield pa.RecordBatch.from_arrays(own + made, labels)

    return df.select(*dict.fromkeys([*names, text])).mapInArrow(run, T.StructType(old + fields))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def _partition_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Where hash partitioning puts an int: Spark's Murmur3 with seed 42, modulo the partitions."""
    u = np.uint32

    def turned(v, r):
        return (v << u(r)) | (v >> u(32 - r))

    with np.errstate(over="ignore"):
        h = turned(u(42) ^ (turned(x.astype(np.uint32) * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        h ^= h >> u(16)
    return h.view(np.int32).astype(np.int64) % parts


_buckets: dict[int, np.ndarray] = {}


def bucket_names(parts: int) -> np.ndarray:
    """One int for each partition, which hash partitioning puts there: buckets of even size fill partitions evenly."""
    if parts not in _buckets:
        out, at = np.full(parts, -1, dtype=np.int32), 0
        while (out < 0).any():
            x = np.arange(at, at + 4 * parts, dtype=np.int32)
            where, first = np.unique(_partition_of(x, parts), return_index=True)
            out[where] = np.where(out[where] < 0, x[first], out[where])
            at += 4 * parts
        _buckets[parts] = out
    return _buckets[parts]


def packed(keys: np.ndarray, parts: int, names: list[str], columns: list[np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows dealt by the hash ``keys`` to partitions: one row of arrays for each partition that gets any.

    Arrays cost a shuffle little more than their values; ``unpacked`` makes rows of them again.
    """
    if not len(keys):
        return
    place = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    place = place[order]
    there, first = np.unique(place, return_index=True)
    offsets = pa.array(np.r_[first, len(place)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, c.take(pa.array(order)) if isinstance(c, pa.Array) else pa.array(c[order])) for c in columns]
    there = bucket_names(parts)[there]
    for at in range(0, len(there), 256):
        yield pa.RecordBatch.from_arrays([pa.array(there[at : at + 256]), *(x.slice(at, 256) for x in lists)], ["bucket", *names])


def unpacked(df: DataFrame, parts: int, names: list[str]) -> DataFrame:
    """``bucket`` and the rows of its arrays; all rows of a bucket are in one partition."""
    rest = [F.get(F.col(n), F.col("_at")).alias(n) for n in names[1:]]
    rows = df.repartition(parts, "bucket").select("bucket", *names[1:], F.posexplode(names[0]).alias("_at", "_first"))
    return rows.select("bucket", F.col("_first").alias(names[0]), *rest)


def counted(rows: DataFrame, name: str, *key: str) -> DataFrame:
    """How many rows share the key, beside each row.  The key's first column is a hash, so sorting by it is a radix sort."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(*key, "bucket")))
