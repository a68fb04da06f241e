"""Batches of texts and streams beside the expressions that look at one at a time, and what the whole queries do not do."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.functions import codec
from rankloom.functions.splitter import split_text
from rankloom.operators import bulk, packed, rankcoder, reports, store
from rankloom.operators.store import context_keys
from rankloom.plans import compress, folder, registry
from rankloom.sources import files

KINDS = {codec.RANK: 0, codec.EXPLICIT: 1, codec.BREAK: 2}


@pytest.mark.parametrize(("least", "most"), [(100, 500), (5, 12), (0, 7)])
def test_chunks_and_tokens_of_a_batch(spark, least, most):
    """F3, F4."""
    rng = random.Random(5)
    bits = ["\n", "\n\n", "\n---\n", "\n=*=\n", " ", ". ", "! ", "?\n", ".  x", "\u0085", ". ", "a", "word ", "é漢😀", "  ", "\t", "\r\n", "\x0b", ".\x1c", "...", "unbroken_" * 9]
    texts = [None, "", *("".join(rng.choices(bits, k=rng.choice([1, 3, 20, 200]))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", split_text(F.col("text"), least, most).alias("c"))
    df = df.select("i", F.coalesce("c", F.array().cast("array<string>")).alias("c")).withColumn("t", F.transform("c", lambda c: rankcoder.tokenize(c)))
    want = [(r.c, r.t) for r in df.orderBy("i").collect()]
    got = []
    for _, raw, bounds, counts in bulk.parts(pa.record_batch([pa.array(texts)], ["text"]), (least, most)):
        starts = bulk.token_starts(raw, bounds)
        tokens, ends = bulk.token_array(raw, starts).to_pylist(), np.searchsorted(starts, bounds)
        each = [(raw[a:b].tobytes().decode(), tokens[x:y]) for a, b, x, y in zip(bounds, bounds[1:], ends, ends[1:])]
        at = np.r_[0, np.cumsum(counts)]
        got += [([c for c, _ in each[a:b]], [t for _, t in each[a:b]]) for a, b in zip(at, at[1:])]
    assert got == want


def test_payloads_of_a_batch(spark):
    """F2, F5."""
    rng = random.Random(3)
    tokens = [("r", 0), ("r", 0), ("r", 0), ("r", 7), ("r", 8), ("r", 63), ("e", 0), ("e", 8191), ("e", 8192), ("e", 1 << 20), ("e", (1 << 27) - 1), ("<BREAK>", 0)]
    rows = [rng.choices(tokens, k=rng.choice([0, 1, 2, 40])) for _ in range(200)] + [[("r", 3)] * a + [("r", 0)] * n + [("r", 5)] for a in (0, 1, 2) for n in (1, 2, 61, 62, 63, 124, 125)]
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, s array<{codec.TOKEN}>")
    flat, ends = [t for r in rows for t in r], np.r_[0, np.cumsum([len(r) for r in rows])]
    for window in (1, 9020, 1 << 21):
        made, at = packed.encode(np.array([KINDS[k] for k, _ in flat], np.int8), np.array([v for _, v in flat]), ends, window)
        assert [made[a:b].tobytes() for a, b in zip(at, at[1:])] == [bytes(r.p) for r in df.select("i", codec.encode(F.col("s"), window).alias("p")).orderBy("i").collect()]
    raws = [bytes(rng.choice([0, 0x45, 0x80, 0x81, 0xBF, 0xC0, 0xC5, 0xFE, 0xFF]) for _ in range(rng.choice([0, 1, 2, 3, 9]))) for _ in range(500)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, p binary").select("i", codec.decode(F.col("p")).alias("d"), codec.fault(F.col("p")).alias("fault"))
    want = [(r.d.window, [(KINDS[t.kind], t.value) for t in r.d.tokens], r.fault) for r in df.orderBy("i").collect()]
    windows, kinds, values, ends, faults = packed.decode(b"".join(raws), np.r_[0, np.cumsum([len(r) for r in raws])])
    both = list(zip(kinds.tolist(), values.tolist()))
    assert [(w, both[a:b], f) for w, a, b, f in zip(windows.tolist(), ends, ends[1:], faults)] == want


def test_a_fit_shuffles_packed_columns(spark):
    """a row for a bucket of many tokens, not a row or two for each token."""
    docs = spark.createDataFrame([(i, "one two three four " * 500) for i in range(40)], "doc_id long, text string").coalesce(1)
    model = compress.Model.fit(docs)
    grams = rankcoder.gram_rows(docs, model.store, model.vocab.count(), 4)
    assert grams.count() <= 8 < 1000 < grams.agg(F.sum("n")).first()[0]


def test_a_round_trip_joins_nothing(spark, tmp_path):
    """F2."""
    spark.createDataFrame([(i, f"text {i} \n\n é", "en") for i in range(5)] + [(5, "", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, "unseen words")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = registry.roundtrip_text(spark, str(tmp_path))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.text for r in made.collect() if r.identical} == {**{i: f"text {i} \n\n é" for i in range(5)}, 5: "", -1: "unseen words"}


def test_a_report_tells_a_wrong_payload(spark):
    """what is compared is what the payload says, beside the text in its row."""
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two"), (3, None), (4, "")], "doc_id long, text string")
    model = compress.Model.fit(docs)
    rows = compress.payload_table(docs, model)
    other = rows.where("doc_id = 2").first().payload
    wrong = rows.withColumn("payload", F.when(F.col("doc_id") == 1, F.lit(other)).otherwise(F.col("payload")))
    told = {r.doc_id: (r.identical, r.tokens_identical, r.error) for r in compress.checked(wrong, model, 64, 100, 500, 0.0).collect()}
    assert told == {1: (False, False, None), 2: (True, True, None), 3: (False, False, "no text"), 4: (True, True, None)}


def test_a_folder_is_packed_once(spark, tmp_path, monkeypatch):
    """F6."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One two three. " * 3000 + "\n\nend")
    model = compress.Model.fit(folder.documents(spark, str(tmp_path / "in")))
    calls, make, looked = [], rankcoder.encode_payloads, rankcoder.streams
    monkeypatch.setattr(rankcoder, "encode_payloads", lambda *a, **k: calls.append(1) or make(*a, **k))
    monkeypatch.setattr(rankcoder, "streams", lambda *a, **k: calls.append(1) or looked(*a, **k))
    told = folder.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), model).first()
    assert told.identical_bytes and told.tokens_identical and len(calls) == 1
    assert (tmp_path / "out" / "Results" / "a.txt").read_bytes() == (tmp_path / "in" / "a.txt").read_bytes()


def _plainly(is_rank, values, starts, sizes, longest, store, k):
    """A walk place by place, with the lists themselves."""
    ids, bad = values.astype(np.int64), np.zeros(len(starts), bool)
    for c, (start, size, most) in enumerate(zip(starts.tolist(), sizes.tolist(), longest.tolist())):
        for i in range(start, start + size):
            if is_rank[i]:
                before = [np.array([ids[max(i - j, 0)]]) for j in (1, 2, 3)]
                keys = context_keys(before, [np.array([i - start >= j and most >= j]) for j in (1, 2, 3)])
                found = [x for key in keys[::-1] for x in _listed(store, int(key[0]))]
                ids[i] = found[values[i]] if values[i] < min(k, len(found)) else 0
                bad[c] |= values[i] >= min(k, len(found))
    return ids, bad


def _listed(store, key):
    for part in map(lambda i: store.part("lists", i), range(len(store.parts["lists"]))):
        at = np.flatnonzero(part["ctx"] == key)
        if len(at):
            return part["ids"][part["first"][at[0]] : part["first"][at[0] + 1]].tolist()
    return []


@pytest.mark.parametrize("few", [0, 5, 1 << 20])
def test_a_walk_with_little_memory(spark, monkeypatch, few):
    """the same ids whether ways are gone together or alone, also where lists share slots and are forgotten in between."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, "".join(f" w{rng.choice([1, 2, 3, 5, 30]) * rng.randrange(1, 9)}" for _ in range(300))) for i in range(40)], "doc_id long, text string")
    made = compress.Model.fit(docs).store
    for name, value in (("SLOTS", 3), ("HELD", 40), ("SINGLE", 4), ("_recent", {})):
        monkeypatch.setattr(store, name, value)
    monkeypatch.setattr(rankcoder, "FEW", few)
    sizes = np.array([rng.choice([1, 2, 9, 60]) for _ in range(60)])
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum())
    is_rank, values = np.array([rng.random() < 0.8 for _ in range(n)]), np.array([rng.choice([0, 0, 1, 2, 7, 63, 64]) for _ in range(n)])
    is_rank[starts[1:] - 1] = False
    values[~is_rank] = [rng.choice([0, 3, 11, made.size + 40, 1 << 22]) for _ in range(int((~is_rank).sum()))]
    is_rank[-1] = False
    longest = np.array([rng.choice([0, 1, 2, 3]) for _ in sizes])
    got, want = (f(is_rank, values, starts, sizes, longest, made, 64) for f in (rankcoder.walked, _plainly))
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist() and 0 < want[1].sum() < len(sizes)


def test_a_long_chunk_takes_no_step_for_each_place(spark, monkeypatch):
    """F5."""
    made = compress.Model.fit(spark.createDataFrame([(0, "one two three four " * 500)], "doc_id long, text string")).store
    calls, picked = [], store.Store.picked
    monkeypatch.setattr(store.Store, "picked", lambda *a: calls.append(1) or picked(*a))
    is_rank, values = np.arange(30000) % 3 > 0, np.zeros(30000, np.int64)
    for longest in (1, 3):  # window 1: the ids between cut it into many short ways; window 3: one way, alone
        ids, bad = rankcoder.walked(is_rank, values, np.zeros(1, np.int64), np.array([30000]), np.array([longest]), made)
        assert not bad.any() and len(calls) < 10


def test_a_timed_sweep_writes_its_totals_only(spark, monkeypatch):
    """no payloads or texts are written on the way; what is measured is the same whole job."""
    docs = spark.createDataFrame([(1, "one two three\n\n" * 40), (2, "é漢😀"), (3, None), (4, "")], "doc_id long, text string")
    model = compress.Model.fit(docs)
    wrote, write = [], compress.written
    monkeypatch.setattr(compress, "written", lambda df: wrote.append(df.columns) or write(df))
    timed = {r.window_size: r for r in compress.sweep(docs, model, [1, 3], timed=True).collect()}
    assert len(wrote) == 1 and "text" not in wrote[0] and "payload" not in wrote[0]
    for w, r in timed.items():
        told = reports.corpus(compress.report(docs, model, w)).first()
        assert r.asDict() == {"window_size": w, "compression_time": r.compression_time, "decompression_time": r.decompression_time, **told.asDict()}
        assert r.n_files == 4 and r.n_identical == 3 and r.compression_time > 0 and r.decompression_time > 0


def test_a_folder_of_blocks_is_the_folder_of_whole_files(spark, tmp_path, monkeypatch):
    """no row has a whole file, and files, sizes and errors are those of whole files."""
    monkeypatch.setattr(files, "TEXT", 300)
    monkeypatch.setattr(files, "PAYLOAD", 40)
    rng = random.Random(11)
    bits = ["\n", "\n\n", "\n---\n", ". ", "word ", "é漢😀", "two words. ", "a", "z" * 60, "\r\n", "\r", "\r\n\r\n", "last! "]
    texts = {f"f{i}.txt": "".join(rng.choices(bits, k=rng.choice([0, 1, 30, 900]))).encode() for i in range(24)}
    texts |= {"long.md": b"no blank line here " * 400, "empty.txt": b"", "narrow.txt": b"caf\xe9\r\n\r\n" * 300, "end.txt": b"x " * 400 + b"\n\n" + b"\r"}
    (tmp_path / "in").mkdir()
    for name, raw in texts.items():
        (tmp_path / "in" / name).write_bytes(raw)
    model = compress.Model.fit(folder.documents(spark, str(tmp_path / "in")))
    whole = folder.documents(spark, str(tmp_path / "in"))
    own = {r.file_name: r for r in compress.report(whole, model, 100).collect()}
    payloads = {r.file_name: bytes(r.payload) for r in compress.payload_table(whole, model, 100).collect()}
    told = {r.file_name: r for r in folder.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), model, 100).collect()}
    assert set(told) == set(own) == set(texts)
    for name, r in own.items():
        assert {k: told[name][k] for k in r.asDict() if not k.endswith("_time")} == {k: v for k, v in r.asDict().items() if not k.endswith("_time")}
        assert (tmp_path / "out" / "Compressed" / f"{name}.bin").read_bytes() == payloads[name]
        assert (tmp_path / "out" / "Results" / name).read_bytes().decode() == whole.where(F.col("file_name") == name).first().text
    blocks = files.scan_blocks(spark, str(tmp_path / "in"), 100, 500)
    assert blocks.count() > 2 * len(texts) and files.scan_payload_blocks(spark, str(tmp_path / "out" / "Compressed")).count() > 2 * len(texts)
    (tmp_path / "out" / "Compressed" / "odd.bin").write_bytes(b"\xff".join([b"\x45\x81\x85"] * 100))
    (tmp_path / "out" / "Compressed" / "wrong.bin").write_bytes(payloads["f1.txt"] + b"\xff\xbf\x7f\x7f\xff" * 30)
    again = {r.file_name: r.error for r in folder.decompress(spark, str(tmp_path / "out" / "Compressed"), str(tmp_path / "again"), model, strict=True).collect()}
    one = {r.file_name: r.back_error for r in rankcoder.decode_payloads(files.scan_payloads(spark, str(tmp_path / "out" / "Compressed")).select("file_name", "payload"), model.store, model.k, True).collect()}
    assert again == one and again["odd"] == "no header" and not (tmp_path / "again" / "odd").exists() and not (tmp_path / "again" / "wrong").exists()
    assert {r.file_name: r.md5 for r in files.text_digests(spark, str(tmp_path / "in")).collect()} == {r.file_name: r.m for r in whole.select("file_name", F.md5("text").alias("m")).collect()}


def test_a_folder_report_reads_no_whole_file(spark, tmp_path, monkeypatch):
    """F1."""
    spark.createDataFrame([(i, f"text {i} of é\n\nand more " * 20, "en") for i in range(60)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def whole(*args, **named):
        raise AssertionError("a file as a row")

    for name in ("scan_texts", "scan_payloads", "write_files"):
        write = files.write_files
        monkeypatch.setattr(files, name, (lambda df, *a: write(df, *a) if "kind" not in df.columns and df.count() == 2 else whole()) if name == "write_files" else whole)
    told = registry.folder_report(spark, str(tmp_path)).collect()
    assert len(told) == 6 and sum(r.error is None for r in told) == 4 and all(r.identical and r.bin_size == r.compressed_size for r in told if r.error is None)


def test_parts_of_a_model_are_written_a_batch_at_a_time(spark, tmp_path, monkeypatch):
    """lists that stand in several batches are whole, and no task gathers a part."""
    rng = random.Random(2)
    lists = {c: rng.sample(range(10**6), rng.choice([1, 2, 9, 64])) for c in rng.sample(range(-(10**12), 10**12), 300)}
    ranks = spark.createDataFrame([(c, i, r) for c, ids in lists.items() for r, i in enumerate(ids)], "ctx long, token_id int, rank int")
    vocab = spark.createDataFrame([(f"é{i}" * (i % 4), i) for i in range(700)], "token string, token_id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        seen = []
        monkeypatch.setattr(store, "_lists", lambda t, *a, f=store._lists, most=64 + 7: f(t, *a) if t.num_rows <= most else seen.append(1))
        store.build_lists(ranks, f"{tmp_path}/m")
        store.build_words(vocab, f"{tmp_path}/m")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = store.Store.load(spark, f"{tmp_path}/m")
    assert {c: made.list(c) for c in lists} == lists and made.size == 700
    keys, ids = (np.array(x) for x in zip(*((c, i) for c, own in lists.items() for i in own)))
    sizes, places = made.ranks(keys, ids)
    assert sizes.tolist() == [len(own) for own in lists.values() for _ in own] and places.tolist() == [r for own in lists.values() for r in range(len(own))]
    assert made.words(np.arange(700)) == [f"é{i}" * (i % 4) for i in range(700)]
