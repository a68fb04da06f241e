import hashlib
import random
import re

import pyarrow as pa
import pytest

from rankloom.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((t or "").translate(LOWER))]


def brute(docs, items):
    wins = {}
    for item, t in items:
        if item is None:
            continue
        w = [x for x, _, _ in words(t)]
        for p in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[p : p + 13]), set()).add(item)
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for p in range(len(w)):
            for n in range(1, 14):
                key = tuple(x for x, _, _ in w[p : p + n])
                if p + n <= len(w) and key in wins:
                    hit.update(range(p, p + n))
                    found |= wins[key]
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        spans = []
        for k in sorted(hit):
            if spans and k - 1 in hit:
                spans[-1][1] = w[k][2]
            else:
                spans.append([w[k][1], w[k][2]])
        out[i] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w), spans)
    return out


@pytest.mark.parametrize("seed,most", [(0, 400_000), (1, 90)])
def test_against_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", most)  # 90: several automata
    r = random.Random(seed)
    pool = [f"{c}{k}" for c in ("A", "b", "é", "漢") for k in range(8)]
    text = lambda n: "".join(r.choice(pool) + r.choice((" ", ", ", "\n", "--", "_")) for _ in range(n))
    items = [(k, text(r.choice((0, 1, 3, 12, 13, 14, 40)))) for k in range(20)] + [(20, None), (None, text(20)), (21, text(30))]
    items.append((22, items[-1][1]))
    docs = []
    for i in range(60):
        t = text(r.choice((0, 2, 30)))
        for _ in range(r.randint(0, 2)):
            part = r.choice(items)[1] or ""
            k = r.randrange(len(part) + 1)
            t += part[k:].upper() if r.random() < 0.5 else part
            t += text(r.choice((0, 5, 200)))
        docs.append((i, t))
    docs.append((60, None))
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    spans = {x.doc_id: [[s.start, s.end] for s in x.spans] for x in found.collect()}
    for x in decontaminate.digest(found).collect():
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated, spans[x.doc_id]) == want[x.doc_id]


def test_edges(spark, edge_docs, no_docs, edge_texts):
    items = spark.createDataFrame([(1, edge_texts[0][1])], "item_id long, text string")
    assert decontaminate.find(edge_docs, items).count() == len(edge_texts)
    kept = decontaminate.clean(edge_docs, items)
    assert kept.columns == edge_docs.columns and {x.doc_id for x in kept.collect()} == {1, 2, 3, 4, 7, 8, 10}
    assert decontaminate.clean(edge_docs, items.limit(0)).count() == len(edge_texts)
    assert decontaminate.find(no_docs, items).count() == 0


def test_ids_of_any_type(spark):
    items = spark.createDataFrame([("q-1", "alpha beta"), ("q-10", "Beta GAMMA"), ("p", "delta")], "item_id string, text string")
    docs = spark.createDataFrame([(0, "alpha beta gamma"), (1, None)], "doc_id long, text string")
    got = {x.doc_id: x["items"] for x in decontaminate.find(docs, items).collect()}
    assert got == {0: ["q-1", "q-10"], 1: []}


def test_words_of_equal_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.vec, "spans_hash", lambda data, s, e, seed=0: (e - s).astype("uint64"))
    scanner = decontaminate.Scanner([((b"ab", b"c"), ("0",))])
    words = decontaminate.vec.words_of(pa.array(["ab c", "xy c", "ab d"]))
    assert list(scanner.scan(words)[1]) == [0]
