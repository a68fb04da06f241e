from collections import Counter

import pytest

from rankloom.llm import sharding


def brute(names, slots):
    """Each shard's whole order of preference, and turns."""
    orders = []
    for n in names:
        o, s = sharding.preference(n, slots)
        orders.append([(o + j * s) % slots for j in range(slots)])
    assert all(len(set(o)) == slots for o in orders)
    owner = {}
    while len(owner) < slots:
        for i, o in enumerate(orders):
            if len(owner) < slots:
                owner[next(x for x in o if x not in owner)] = i
    return [owner[x] for x in range(slots)]


@pytest.mark.parametrize("shards,slots", [(1, 2), (3, 7), (5, 211), (64, 1009)])
def test_table(shards, slots):
    names = sharding.shard_names(shards)
    got = sharding.lookup_table(names, slots)
    assert got == brute(names, slots)
    sizes = Counter(got).values()
    assert max(sizes) - min(sizes) <= 1


def test_losing_a_shard_moves_little():
    names = sharding.shard_names(64)
    before, after = sharding.lookup_table(names), sharding.lookup_table(names[:63])
    moved = sum(a != b for a, b in zip(before, after) if a != 63)
    assert moved < 0.1 * len(before)


@pytest.mark.parametrize("names,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, slots)


def test_edges(spark, edge_docs, no_docs, edge_texts, tmp_path):
    rows = sharding.assign(edge_docs, "doc_id").collect()
    assert len(rows) == len(edge_texts) and all(0 <= x.shard < 64 and 0 <= x.slot < sharding.SLOTS for x in rows)
    assert len({x.shard for x in rows if x.doc_id == 5}) == 1
    assert sharding.assign(no_docs, "doc_id").count() == 0
    sharding.write_shards(edge_docs.select("doc_id", "text"), "doc_id", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(edge_texts)
