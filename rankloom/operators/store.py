"""A fitted model of any size as flat arrays in the shared folder, looked up by many keys at a time.

Tasks write the parts of a model, each a range of keys; workers map them into memory, so a worker holds what
it touches and all workers of a machine share it.  A file that can't be mapped, as in an object store, is read.

Of the lists: ``ctx`` (sorted), ``first`` (where each list begins), ``ids`` (best first), ``sorted`` and ``rank`` (the
same by id; the list's number stands above an id).  Of the vocabulary, by hash: ``hash`` (sorted) and ``id``; by id: Arrow's buffers of the words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession

#: Entries of a part, about, in models of over ``PARTS`` parts; smaller ones have at most so many parts.  A look-up goes through all parts.
PART, PARTS = 1 << 22, 16
#: A context's key where ids are below 2**21 - 1, as they nearly always are: each id plus one, the last token lowest.
ID_BITS = 21
#: The key of a place that has not so many tokens before it.
NONE = np.int64(-(1 << 63))


def hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word."""
    return hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64)


def context_keys(before: list[np.ndarray], there: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of the contexts of 0, 1, ... tokens; ``before``: the last token, the one before it, ...; ``there``: whether it exists.

    Ids of 2**21 - 1 and above would not fit: such a context's key is a hash below zero.
    """
    n = len(before[0])
    keys = [np.zeros(n, np.int64)]
    key, mixed, wide = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, bool)
    for j, (ids, ok) in enumerate(zip(before, there)):
        one = np.where(ok, ids, 0).astype(np.int64) + 1
        wide |= one >= 1 << ID_BITS
        key = key + (np.where(wide, 0, one) << ID_BITS * j)
        mixed = (mixed ^ one.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        hashed = -1 - (mixed >> np.uint64(2)).view(np.int64)
        keys.append(np.where(ok, np.where(wide, hashed, key), NONE))
    return keys


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file:///" + path.removeprefix("file:").lstrip("/"))


def _got(path: str, kind, size: int) -> np.ndarray:
    from pyarrow import fs

    if not size:
        return np.empty(0, kind)
    system, inner = _system(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.asarray(np.memmap(inner, kind, "r", shape=(size,)))
    with system.open_input_file(inner) as f:
        return np.frombuffer(f.read(), kind)


#: Part files of each kind: name, type, and which of the two sizes it has.
_FILES = {
    "lists": {"ctx": ("<i8", 0), "first": ("<u4", 2), "ids": ("<i4", 1), "sorted": ("<i8", 1), "rank": ("u1", 1)},
    "hashes": {"hash": ("<i8", 0), "id": ("<i4", 0)},
    "words": {"at": ("<i8", 2), "bytes": ("u1", 1)},
}
_MADE = "kind string, name string, low long, high long, n long, m long"


def _write(rows: DataFrame, kind: str, path: str, arrays: Callable[[pa.Table, int, int], tuple[int, int, int, int, dict[str, np.ndarray]]], whole: str | None = None) -> DataFrame:
    """A row about each part: the partitions of ``rows``, each written by its task under a name of its own, a batch at a time.

    ``arrays`` gets some rows and the sizes so far; rows that are equal in ``whole``, which stand together, come together.
    """

    def pieces(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            last = t.column(whole).to_numpy() if whole else None
            at = int(np.searchsorted(last, last[-1])) if whole else t.num_rows  # sorted
            held = t.slice(at) if whole else None
            if at:
                yield t.slice(0, at)
        if held is not None:
            yield held

    def run(batches):
        import uuid

        own, files = f"{kind}-{uuid.uuid4().hex}", {}
        low, high, n, m = None, None, 0, 0
        for t in pieces(batches):
            first, high, more, wide, made = arrays(t, n, m)
            if kind == "words" and files and first != low + n:
                raise ValueError("ids of a vocabulary are dense")
            if not files:
                low = first
                system, inner = _system(f"{path}/{own}")
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                files = {name: system.open_output_stream(f"{inner}.{name}") for name in made}
                for name, (t_, which) in _FILES[kind].items():
                    if which == 2:
                        files[name].write(np.zeros(1, t_).tobytes())
            for name, array in made.items():
                files[name].write(np.ascontiguousarray(array, _FILES[kind][name][0]).tobytes())
            n, m = n + more, m + wide
        for f in files.values():
            f.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([own]), *(pa.array([x], pa.int64()) for x in (low, high, n, m))], ["kind", "name", "low", "high", "n", "m"])

    return rows.mapInArrow(run, _MADE)


def _lists(t: pa.Table, n: int, m: int):
    ctx, ids = (t.column(c).to_numpy() for c in ("ctx", "token_id"))
    first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
    ends = np.r_[first[1:], len(ctx)]
    sizes = ends - first
    both = (np.repeat(n + np.arange(len(first)), sizes) << 32) | ids
    by = np.argsort(both)
    own = {"ctx": ctx[first], "first": m + ends, "ids": ids, "sorted": both[by], "rank": by - np.repeat(first, sizes)}
    return int(ctx[0]), int(ctx[-1]), len(first), len(ctx), own


def _hashes(t: pa.Table, n: int, m: int):
    h = t.column("h").to_numpy()
    return int(h[0]), int(h[-1]), len(h), 0, {"hash": h, "id": t.column("token_id").to_numpy()}


def _words(t: pa.Table, n: int, m: int):
    ids, words = t.column("token_id").to_numpy(), t.column("token").combine_chunks().cast(pa.large_string())
    words = pa.concat_arrays([words.chunk(i) for i in range(words.num_chunks)]) if isinstance(words, pa.ChunkedArray) else words
    if len(ids) != int(ids[-1]) - int(ids[0]) + 1:
        raise ValueError("ids of a vocabulary are dense")
    _, at, raw = words.buffers()
    at = np.frombuffer(at, "<i8")[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(raw, "u1")[at[0] : at[-1]] if raw is not None else np.empty(0, "u1")
    return int(ids[0]), int(ids[-1]), len(ids), len(raw), {"at": m + at[1:] - at[0], "bytes": raw}


def _cut(df: DataFrame, n: int, *by: str) -> DataFrame:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(max(1, min(least, n // 1000, PARTS), n // PART), by[0]).sortWithinPartitions(*by)


def build_words(vocab: DataFrame, path: str) -> None:
    """Writes a vocabulary below ``path``: its parts, and a table that names them."""

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(b.column(0))), b.column(1)], ["h", "token_id"])

    n = vocab.count()
    by_hash = vocab.select("token", "token_id").mapInArrow(hashed, "h long, token_id int")
    made = _write(_cut(vocab.select("token_id", "token"), n, "token_id"), "words", path, _words)
    made.union(_write(_cut(by_hash, n, "h", "token_id"), "hashes", path, _hashes)).write.parquet(f"{path}/parts-words")


def build_lists(ranks: DataFrame, path: str) -> None:
    """Writes the lists below ``path``."""
    _write(_cut(ranks.select("ctx", "rank", "token_id"), ranks.count(), "ctx", "rank"), "lists", path, _lists, "ctx").write.parquet(f"{path}/parts-lists")


#: Slots of a worker's memory of lists, as a power of two; entries that it begins anew after; lists that single look-ups keep.
SLOTS, HELD, SINGLE = 20, 1 << 22, 1 << 16


class Recent:
    """Lists that a worker has looked up last, each in the one slot that its key has: what is not there is looked up in the parts."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.key = np.full(1 << SLOTS, NONE, np.int64)
        self.start, self.size, self.turn = (np.zeros(1 << SLOTS, np.int32) for _ in range(3))
        self.ids, self.used = np.empty(HELD, np.int32), 0

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOTS)).view(np.int64)

    def room(self, n: int) -> None:
        if self.used + n > len(self.ids):
            self.key[:], self.size[:] = NONE, 0
            self.ids, self.used = np.empty(max(HELD, n), np.int32), 0


#: By the model's first part: tasks of a worker that read the same model share what they have looked up.
_recent: dict[str, Recent] = {}


class Store:
    """What a worker has of a model.  Pickled, it is the names of its parts."""

    def __init__(self, parts: dict[str, list[tuple]]):
        self.parts, self.size = parts, sum(p[3] for p in parts["words"])
        self.open: dict[str, dict[str, np.ndarray]] = {}
        self.lows = {k: np.array([p[1] for p in v], np.int64) for k, v in parts.items()}

    @classmethod
    def load(cls, spark: SparkSession, path: str, lists: bool = True) -> Store:
        rows = []
        for kind in ("words", "lists")[: 1 + lists]:
            rows += spark.read.schema(_MADE).parquet(f"{path}/parts-{kind}").collect()  # a row for each part
        return cls({k: sorted(((f"{path}/{r['name']}", r["low"], r["high"], r["n"], r["m"]) for r in rows if r["kind"] == k), key=lambda p: p[1]) for k in _FILES})

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def part(self, kind: str, i: int) -> dict[str, np.ndarray]:
        path, low, _, n, m = self.parts[kind][i]
        if path not in self.open:
            self.open[path] = {name: _got(f"{path}.{name}", t, (n, m, n + 1)[which]) for name, (t, which) in _FILES[kind].items()} | {"low": low}
        return self.open[path]

    def each(self, kind: str, keys: np.ndarray):
        """(part, places of ``keys`` in the part's range, these keys); keys come sorted."""
        if not self.parts[kind] or not len(keys):
            return
        order = np.argsort(keys)
        own = keys[order]
        start = 0
        for i, end in enumerate([*np.searchsorted(own, self.lows[kind][1:], "left").tolist(), len(own)]):
            if start < end:
                yield self.part(kind, i), order[start:end], own[start:end]
            start = end

    def token_ids(self, words: pa.Array) -> np.ndarray:
        """Ids of different words; -1 for those outside the vocabulary.  Words of equal hash are told apart by their texts."""
        out = np.full(len(words), -1, np.int64)
        h = hashes(words)
        for part, places, own in self.each("hashes", h):
            at = np.searchsorted(part["hash"], own)
            todo = np.arange(len(own))
            while len(todo):
                inside = at[todo] < len(part["hash"])
                todo = todo[inside]
                todo = todo[part["hash"][at[todo]] == own[todo]]
                if not len(todo):
                    break
                ids = part["id"][at[todo]].astype(np.int64)
                same = np.asarray(self.words(ids), dtype=object) == words.take(pa.array(places[todo])).to_numpy(zero_copy_only=False)
                out[places[todo[same]]] = ids[same]
                todo = todo[~same]
                at[todo] += 1
        return out

    def words(self, ids: np.ndarray) -> list[str]:
        """The words of ids of the vocabulary."""
        out = np.empty(len(ids), object)
        for part, places, own in self.each("words", np.asarray(ids, np.int64)):
            n = len(part["at"]) - 1
            all_ = pa.LargeStringArray.from_buffers(n, pa.py_buffer(part["at"]), pa.py_buffer(part["bytes"]))
            out[places] = all_.take(pa.array(own - part["low"])).to_numpy(zero_copy_only=False)
        return out.tolist()

    def _found(self, keys: np.ndarray):
        for part, places, own in self.each("lists", keys):
            at = np.searchsorted(part["ctx"], own)
            at[at == len(part["ctx"])] = 0
            known = part["ctx"][at] == own
            at, places = at[known], places[known]
            yield part, places, at, part["first"][at].astype(np.int64), part["first"][at + 1].astype(np.int64)

    def ranks(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, the length of its list and the rank of the id in it, -1 if it is not there."""
        sizes, ranks = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for part, places, own, low, high in self._found(keys):
            sizes[places] = high - low
            asked = (own << 32) | ids[places]
            at = np.minimum(np.searchsorted(part["sorted"], asked), len(part["sorted"]) - 1)
            hit = part["sorted"][at] == asked
            ranks[places[hit]] = part["rank"][at[hit]]
        return sizes, ranks

    def recent(self) -> Recent:
        name = self.parts["lists"][0][0] if self.parts["lists"] else ""
        if name not in _recent:
            _recent.clear()
            _recent[name] = Recent()
        return _recent[name]

    def picked(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, the length of its list and the id at a place of it, -1 beyond it."""
        held = self.recent()
        slots = held.slots(keys)
        sizes, ids = np.empty(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):  # keys that share a slot take turns
            own, slot = keys[todo], slots[todo]
            new = np.flatnonzero(held.key[slot] != own)
            if len(new):
                asked, turn = slot[new], np.arange(len(new))
                held.turn[asked] = turn
                first = held.turn[asked] == turn
                self._fetch(held, own[new[first]], asked[first])
                known = held.key[slot] == own
                todo, rest, slot = todo[known], todo[~known], slot[known]
            else:
                rest = todo[:0]
            n, place = held.size[slot], at[todo]
            sizes[todo] = n
            ids[todo] = np.where(place < n, held.ids[np.where(place < n, held.start[slot] + place, 0)], -1)
            todo = rest
        return sizes, ids

    def _fetch(self, held: Recent, keys: np.ndarray, slots: np.ndarray) -> None:
        """Puts lists into their slots, which are all different; of keys that have no list, an empty one."""
        got, lists = [], [np.empty(0, np.int32)]
        for part, places, _, low, high in self._found(keys):
            n = high - low
            ends = np.cumsum(n)
            if len(n):
                lists.append(part["ids"][np.repeat(low - (ends - n), n) + np.arange(ends[-1])])
                got.append((places, n))
        ids = np.concatenate(lists)
        held.room(len(ids))
        held.key[slots], held.size[slots] = keys, 0
        if got:
            places, n = (np.concatenate(x) for x in zip(*got))
            held.start[slots[places]], held.size[slots[places]] = held.used + np.cumsum(n) - n, n
            held.ids[held.used : held.used + len(ids)] = ids
            held.used += len(ids)

    def list(self, key: int) -> list[int]:
        """The list of one context, best first."""
        lists = self.recent().lists
        got = lists.get(key)
        if got is None:
            got = []
            i = int(np.searchsorted(self.lows["lists"], key, "right")) - 1
            if i >= 0:
                part = self.part("lists", i)
                at = int(np.searchsorted(part["ctx"], key))
                if at < len(part["ctx"]) and part["ctx"][at] == key:
                    got = part["ids"][int(part["first"][at]) : int(part["first"][at + 1])].tolist()
            if len(lists) >= SINGLE:
                lists.clear()
            lists[key] = got
        return got
