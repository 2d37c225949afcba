"""Passages of evaluation items in a corpus, by CGK embedding and symbol-sampling LSH.

The unit is a window of ``width`` consecutive words (maximal runs of letters and digits, without
case) of an item. It is sought at every place of every document:

1. A place is only walked from if enough runs of 2 and of 3 words behind it occur in items. An edit
   changes at most as many runs of a window as a run has words, so a window within ``max_edits``
   edits always has enough left (the q-gram lemma) and this loses nothing; the runs of the items
   are bits of a table of fixed size.
2. Item windows and the words at the place are embedded by the CGK random walk: over ``3 * width``
   steps it emits the word it stands on and moves on or stays by a random function of step and
   word, so texts at a small edit distance get strings at a small Hamming distance. Of these
   strings, ``tables`` samples of ``bits`` positions a walk are hashed; what agrees in any table is
   a candidate. Windows without any edit always agree in every table, so for them recall is 1 by
   construction.
3. Candidates are verified by exact word edit distance, with as many words of the document (up to
   ``max_edits`` more or fewer than the window has) as fit best, so inserted and deleted words count
   one each. Words are compared, not their hashes: a word of a document that has the hash of
   another word of an item gets another number. Before the distances, pairs are dropped in which
   more than ``max_edits`` words of the item are not in the document's words at all.

Item windows are made, hashed and counted in the executors. Up to ``index_windows`` of them (about 1
KB each) are broadcast as an index; more are joined by key with the walked places of the
documents. In either case documents are read once, whatever the number of items, and never joined
with each other.

Results for unusual input: null or empty texts and items with fewer than ``width`` words have no
windows and no rows; null ids take no part. Texts of any length are read whole, in slices. Repeated
texts are found each under its id, repeated items too; rows of one document id are put together.
Other columns are ignored. Empty tables give an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.durable import durable
from tallyloom.llm.bits import bit_table, is_set


@dataclass(frozen=True)
class Walks:
    width: int = 13
    walks: int = 16
    tables: int = 3
    bits: int = 5
    max_edits: int = 2
    index_windows: int = 100_000
    slice_windows: int = 50_000
    seed: int = 17

    @property
    def reach(self) -> int:
        """Most words of a document that a window may cover."""
        return self.width + self.max_edits


#: For windows without edits, which agree in every table, one table is enough.
EXACT = Walks(walks=1, tables=1, bits=8, max_edits=0)
#: Lengths of the runs that are counted.
RUNS = (2, 3)
#: The table of runs has 2**RUN_BITS bits.
RUN_BITS = 26
#: Key bits that the table of used keys of an index has.
FLAG_BITS = 23


WORD = re.compile(r"[^\W_]+")
PAD = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers before it starts anew.
REMEMBER = 500_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


class Hasher(dict):
    """Numbers of words, remembered per worker: their 64-bit hashes, but never that of another word of
    ``names`` (number to word)."""

    def __init__(self, names: dict[int, str] | None = None) -> None:
        self.names = names or {}

    def __missing__(self, word: str) -> int:
        import xxhash

        seed, h = 0, xxhash.xxh64_intdigest(word)
        while self.names.get(h, word) != word:
            seed += 1
            h = xxhash.xxh64_intdigest(word, seed)
        self[word] = h
        return h

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(self) > REMEMBER:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def _constants(opt: Walks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(opt.seed)
    steps = 3 * opt.width
    odd = lambda *shape: rng.integers(0, 2**63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    # Early steps carry the start of a window, late ones are mostly padding: sample the first two thirds.
    places = np.stack([np.stack([np.sort(rng.choice(2 * opt.width, opt.bits, replace=False)) for _ in range(opt.tables)]) for _ in range(opt.walks)])
    return odd(opt.walks, steps), places, odd(opt.walks, opt.tables, opt.bits)


def signatures(flat: np.ndarray, starts: np.ndarray, opt: Walks) -> np.ndarray:
    """Keys (windows x walks*tables) of the windows of ``opt.width`` words at ``starts``."""
    move, places, mix = _constants(opt)
    keys = np.zeros((len(starts), opt.walks * opt.tables), dtype=np.uint64)
    last = int(places.max()) + 1
    with np.errstate(over="ignore"):
        for r in range(opt.walks):
            at = np.zeros(len(starts), dtype=np.int64)
            for j in range(last):
                inside = at < opt.width
                sym = np.where(inside, flat[starts + np.minimum(at, opt.width - 1)], PAD)
                for t in range(opt.tables):
                    where = np.flatnonzero(places[r, t] == j)
                    if len(where):
                        keys[:, r * opt.tables + t] += (sym ^ (sym >> np.uint64(29))) * mix[r, t, where[0]]
                at += (((sym ^ (sym >> np.uint64(31))) * move[r, j]) >> np.uint64(63)).astype(np.int64) & inside
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0xD6E8FEB86659FD93)
        keys += np.arange(keys.shape[1], dtype=np.uint64) * PAD  # one key space for all tables
    return keys


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Word edit distances of rows of a (pairs x width) to the best beginnings of rows of b (pairs x
    width + limit), banded; limit + 1 means more."""
    n, w = a.shape
    far, wide = limit + 1, b.shape[1]
    out, at = np.full(n, far, dtype=np.int16), np.arange(n)
    prev = np.full((n, wide + 1), far, dtype=np.int16)
    prev[:, : limit + 1] = np.arange(limit + 1)
    for i in range(1, w + 1):
        cur = np.full((n, wide + 1), far, dtype=np.int16)
        if i <= limit:
            cur[:, 0] = i
        for j in range(max(1, i - limit), min(wide, i + limit) + 1):
            best = prev[:, j - 1] + (a[:, i - 1] != b[:, j - 1])
            best = np.minimum(best, prev[:, j] + 1)
            cur[:, j] = np.minimum(np.minimum(best, cur[:, j - 1] + 1), far)
        prev = cur
        if i % 3 == 0:  # pairs beyond the limit stay there
            near = np.flatnonzero(prev.min(1) < far)
            a, b, prev, at, n = a[near], b[near], prev[near], at[near], len(near)
    out[at] = prev[:, max(0, w - limit) :].min(1) if n else far
    return out


def runs(flat: np.ndarray, q: int, opt: Walks) -> np.ndarray:
    """Bit numbers of the runs of q words that begin at each word but the last ``q - 1``."""
    mix = np.random.default_rng(opt.seed + q).integers(0, 2**63, q, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = max(0, len(flat) - q + 1)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            x = flat[k : k + n]
            h += (x ^ (x >> np.uint64(31))) * mix[k]
        h ^= h >> np.uint64(29)
        h *= PAD
    return (h >> np.uint64(64 - RUN_BITS)).astype(np.int64)


def marks(words_: np.ndarray) -> np.ndarray:
    """One of 64 bits a word."""
    return np.uint64(1) << ((words_ ^ (words_ >> np.uint64(33))) & np.uint64(63))


WINDOWS = "item_id long, pos int, toks array<string>, keys array<long>"


def _cut(opt: Walks):
    """The windows of items, with their words and keys."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                t = words(text)
                n = len(t) - opt.width + 1
                for s in range(0, max(n, 0), opt.slice_windows):
                    m = min(opt.slice_windows, n - s)
                    part = t[s : s + m + opt.width - 1]
                    keys = signatures(hasher(part), np.arange(m), opt)
                    width = keys.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), pa.array(keys.ravel().view(np.int64)))
                    cols = [pa.array([item] * m, pa.int64()), pa.array(np.arange(s, s + m, dtype=np.int32)), pa.array([part[i : i + opt.width] for i in range(m)], pa.list_(pa.string())), lists]
                    yield pa.RecordBatch.from_arrays(cols, names=["item_id", "pos", "toks", "keys"])

    return go


def item_windows(items: DataFrame, opt: Walks) -> DataFrame:
    rows = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    return rows.mapInArrow(_cut(opt), WINDOWS)


def _run_table(windows: DataFrame, opt: Walks) -> np.ndarray:
    """The runs of all item windows as packed bits."""

    def places():
        hasher = Hasher()

        def of(b: pa.RecordBatch) -> np.ndarray:
            flat = hasher(b.column("toks").flatten().to_pylist())
            inside = np.arange(len(flat)) % opt.width
            return np.concatenate([runs(flat, q, opt)[inside[: max(0, len(flat) - q + 1)] <= opt.width - q] for q in RUNS])

        return of

    return bit_table(windows.select("toks"), places, RUN_BITS)


def index_of(windows: pa.Table, opt: Walks) -> dict | None:
    """The item windows of a broadcast index: words, owners, and keys sorted for lookup. None if two
    words of items have one hash."""
    windows = windows.combine_chunks()
    hasher = Hasher()
    win = hasher(windows.column("toks").combine_chunks().flatten().to_pylist()).reshape(-1, opt.width)
    names = {h: w for w, h in hasher.items()}
    if len(names) < len(hasher):
        return None
    keys = windows.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(keys, kind="stable")
    flags = np.zeros(2**FLAG_BITS, dtype=bool)
    flags[(keys >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True
    return {
        "names": names, "win": win, "marks": np.bitwise_or.reduce(marks(win), axis=1) if len(win) else np.empty(0, np.uint64),
        "owner": windows.column("item_id").to_numpy(), "keys": keys[order], "row": (order // (opt.walks * opt.tables)).astype(np.int32), "flags": flags,
    }


class Corpus:
    """The words of a batch of documents in one array, each document followed by padding."""

    def __init__(self, ids: list, texts: list, hasher: Hasher, opt: Walks) -> None:
        self.ids, self.opt = ids, opt
        tokens = [words(t) for t in texts]
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        pad = np.full(opt.reach, PAD)
        self.flat = np.concatenate([x for t in tokens for x in (hasher(t), pad)] or [pad])
        self.tokens, self.begin = tokens, np.cumsum(size + opt.reach) - size - opt.reach
        n = np.maximum(size - (opt.width - opt.max_edits) + 1, 0)
        self.owner = np.repeat(np.arange(len(ids)), n)
        self.starts = np.repeat(self.begin - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def keep_near_runs(self, table: np.ndarray) -> None:
        """Only places with enough runs of items within reach."""
        opt, near = self.opt, np.ones(len(self.starts), dtype=bool)
        for q in RUNS:
            bit = runs(self.flat, q, opt)
            hit = is_set(table, bit)
            upto = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
            end = np.minimum(self.starts + opt.reach - q + 1, len(hit))
            near &= upto[end] - upto[self.starts] >= opt.width - q + 1 - opt.max_edits * q
        self.starts, self.owner = self.starts[near], self.owner[near]

    def marks(self) -> np.ndarray:
        """Bits of the words within reach of each word."""
        own = marks(self.flat)
        out = own.copy()
        for k in range(1, self.opt.reach):
            out[:-k] |= own[k:]
        return out

    def words_at(self, i: int) -> list[str]:
        d = self.owner[i]
        s = int(self.starts[i] - self.begin[d])
        return self.tokens[d][s : s + self.opt.reach]


def exact_edits(pairs: list[tuple[list[str], list[str]]], opt: Walks) -> np.ndarray:
    """Edits of (item words, document words), compared as words."""
    number: dict[str, int] = {}
    a = np.array([[number.setdefault(w, len(number)) for w in x] for x, _ in pairs], dtype=np.int64).reshape(-1, opt.width)
    b = np.full((len(pairs), opt.reach), -1, dtype=np.int64)
    for i, (_, y) in enumerate(pairs):
        b[i, : len(y)] = [number.get(w, -1) for w in y]
    return edit_distance(a, b, opt.max_edits)


def _match(c: Corpus, near: np.ndarray, lo: int, hi: int, index: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Verified (place number, item id, edits) of the places lo to hi."""
    opt, starts = c.opt, c.starts[lo:hi]
    keys = signatures(c.flat, starts, opt)
    at, _ = np.nonzero(hit := index["flags"][(keys >> np.uint64(64 - FLAG_BITS)).astype(np.int64)])
    k = keys[hit]
    first, last = np.searchsorted(index["keys"], k, "left"), np.searchsorted(index["keys"], k, "right")
    n = last - first
    at, first, n = at[n > 0], first[n > 0], n[n > 0]
    bound, s = np.cumsum(n), 0
    while s < len(n):  # expand candidate pairs in bounded chunks
        e = max(s + 1, int(np.searchsorted(bound, (bound[s - 1] if s else 0) + 500_000, "right")))
        m = n[s:e]
        place = np.repeat(at[s:e], m)
        row = index["row"][np.repeat(first[s:e], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        some = np.flatnonzero(np.bitwise_count(index["marks"][row] & ~near[starts[place]]) <= opt.max_edits)
        pair = np.sort(place[some] * len(index["win"]) + row[some])
        place, row = np.divmod(pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair, len(index["win"]))
        edits = edit_distance(index["win"][row], c.flat[starts[place][:, None] + np.arange(opt.reach)], opt.max_edits)
        ok = edits <= opt.max_edits
        yield place[ok] + lo, index["owner"][row[ok]], edits[ok]
        s = e


PAIRS = "doc_id long, item_id long, edits int, windows long, exact_windows long"


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "edits", "windows", "exact_windows"])


def _scan(index_var, table_var, opt: Walks):
    held: dict = {}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = held.setdefault("hasher", Hasher(index_var.value["names"]))
        for b in batches:
            c = Corpus(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), hasher, opt)
            c.keep_near_runs(table_var.value)
            near = c.marks()
            best: dict[tuple[int, int], list[int]] = {}
            for s in range(0, len(c.starts), opt.slice_windows):
                for place, item, edits in _match(c, near, s, min(s + opt.slice_windows, len(c.starts)), index_var.value):
                    for d, i, e in zip(c.owner[place].tolist(), item.tolist(), edits.tolist()):
                        r = best.setdefault((d, i), [e, 0, 0])
                        r[0] = min(r[0], e)
                        r[1] += 1
                        r[2] += e == 0
            yield _pairs([(c.ids[d], i, *r) for (d, i), r in best.items()])

    return go


PLACES = "doc_id long, place long, toks array<string>, keys array<long>"


def _places(table_var, opt: Walks):
    """The walked places of documents, with their words and keys."""
    held: dict = {}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = held.setdefault("hasher", Hasher())
        for b in batches:
            c = Corpus(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), hasher, opt)
            c.keep_near_runs(table_var.value)
            for s in range(0, len(c.starts), opt.slice_windows):
                e = min(s + opt.slice_windows, len(c.starts))
                keys = signatures(c.flat, c.starts[s:e], opt)
                d = c.owner[s:e]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(e - s + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int64)))
                cols = [pa.array([c.ids[i] for i in d], pa.int64()), pa.array(c.starts[s:e] - c.begin[d]), pa.array([c.words_at(i) for i in range(s, e)], pa.list_(pa.string())), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "place", "toks", "keys"])

    return go


def _verify(opt: Walks):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edits = exact_edits(list(zip(b.column("item_toks").to_pylist(), b.column("toks").to_pylist())), opt)
            ids = zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), edits.tolist())
            yield _pairs([(d, i, e, 1, int(e == 0)) for d, i, e in ids if e <= opt.max_edits])

    return go


def _joined(docs: DataFrame, windows: DataFrame, table_var, opt: Walks) -> DataFrame:
    """Pairs of places and item windows that share a key, verified; one row a pair of windows."""
    places = durable(docs.mapInArrow(_places(table_var, opt), PLACES).withColumn("pid", F.monotonically_increasing_id()))
    # Equal windows of several items are compared once.
    texts = windows.groupBy("toks").agg(F.first("keys").alias("keys"), F.collect_set("item_id").alias("owners")).withColumn("wid", F.monotonically_increasing_id())
    texts = durable(texts)
    left = places.select("pid", F.explode("keys").alias("key"))
    right = texts.select("wid", F.explode("keys").alias("key"))
    pairs = left.join(right, "key").select("pid", "wid").distinct()
    full = pairs.join(texts.select("wid", F.col("toks").alias("item_toks"), F.explode("owners").alias("item_id")), "wid").join(places.select("pid", "doc_id", "toks"), "pid")
    return full.select("doc_id", "item_id", "item_toks", "toks").mapInArrow(_verify(opt), PAIRS)


def leaks(spark: SparkSession, documents: DataFrame, items: DataFrame, opt: Walks = Walks()) -> DataFrame:
    """doc_id, item_id, edits (of the best window), windows and exact_windows (window pairs found)."""
    windows = durable(item_windows(items, opt))
    table = spark.sparkContext.broadcast(_run_table(windows, opt))
    docs = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    index = index_of(windows.toArrow(), opt) if windows.count() <= opt.index_windows else None
    if index is not None:
        found = docs.mapInArrow(_scan(spark.sparkContext.broadcast(index), table, opt), PAIRS)
    else:
        found = _joined(docs, windows, table, opt)
    return found.groupBy("doc_id", "item_id").agg(*[f(c).alias(c) for f, c in ((F.min, "edits"), (F.sum, "windows"), (F.sum, "exact_windows"))])


def leaked_items(found: DataFrame) -> DataFrame:
    """Per item: documents that hold it, exactly or in changed form."""
    return found.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("docs"), F.countDistinct(F.when(F.col("edits") == 0, F.col("doc_id"))).alias("exact_docs"), F.max("windows").alias("most_windows")
    )
