"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: slot
``(offset + j * skip) mod size``.  Shards take turns; in its turn a shard claims the first
free slot of its order.  The filled table is small and of a fixed size, so it goes to the
executors inside the plan, and a row's shard is one array lookup.  Shards' shares differ by
one slot at most, and a shard that comes or goes moves few rows besides its own.

Nulls: a null key is placed as the text ``''``.  Equal keys share a shard.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters: slots (a prime, over 100 for each shard) and shards.
SLOTS = 6553
SHARDS = 64

#: A larger table is refused: it is a literal of the plan.
MOST_SLOTS = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard: the first and the second seven hex digits of the MD5 of its name."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:7], 16) % slots, int(digest[7:14], 16) % (slots - 1) + 1


def shard_names(shards: int) -> list[str]:
    return [f"shard-{i}" for i in range(shards)]


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (an index of ``names``) of each slot."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names, one at least")
    if not _prime(slots) or slots > MOST_SLOTS or slots < len(names):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    places = [preference(n, slots) for n in names]
    owner, at, free = [-1] * slots, [0] * len(names), slots
    while free:
        for i, (offset, skip) in enumerate(places):
            while owner[slot := (offset + at[i] * skip) % slots] >= 0:
                at[i] += 1
            owner[slot] = i
            at[i] += 1
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 13 hex digits of the key's MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % F.lit(slots)


def assign(df: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (long, int); columns of these names are replaced."""
    owner = lookup_table(names or shard_names(SHARDS), slots)
    placed = F.array(*[F.lit(x) for x in owner]) if slots < 64 else F.from_json(F.lit(str(owner)), "array<int>")
    slot = slot_of(F.col(key), slots)
    return df.withColumn("slot", slot).withColumn("shard", F.element_at(placed, (F.col("slot") + 1).cast("int")))


def write_shards(df: DataFrame, key: str, path: str, names: list[str] | None = None, slots: int = SLOTS) -> None:
    """Writes one folder for each shard.  Rows are spread by shard and slot, so a shard is many files of even size."""
    assign(df, key, names, slots).repartition("shard", "slot").write.partitionBy("shard").parquet(path)
