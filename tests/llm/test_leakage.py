import random

import numpy as np
import pytest

from tallyloom.llm import leakage as L


def corpus(seed=0, n=40, size=80):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choice(vocab) for _ in range(size)) for _ in range(n)]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(docs)], "doc_id long, text string, item_id string, edits int"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
    )


def run(spark, docs, items, opt=L.Walks()):
    return L.leaks(spark, *frames(spark, docs, items), opt)


def brute(docs, items, width=13):
    grams = {}
    for i, t in enumerate(items):
        w = L.words(t)
        for s in range(len(w) - width + 1):
            grams.setdefault(tuple(w[s : s + width]), set()).add(i)
    return {(i, d) for d, t in enumerate(docs) for w in [L.words(t)] for s in range(len(w) - width + 1) for i in grams.get(tuple(w[s : s + width]), ())}


@pytest.mark.parametrize("opt", [L.Walks(), L.Walks(index_windows=60, slice_windows=7)], ids=["index", "joined"])
def test_exact_passages_against_brute_force(spark, opt):
    docs, items = corpus(1), corpus(2, 8, 30)
    for d, (i, a, b) in {0: (0, 0, 30), 1: (1, 5, 18), 2: (2, 5, 17), 3: (3, 10, 30)}.items():
        docs[d] = docs[d][:100] + "! <b>" + "-\n".join(items[i].upper().split()[a:b]) + "</b> " + docs[d][100:]
    docs += [docs[0], "", None, "short text"]
    got = {(r.item_id, r.doc_id) for r in run(spark, docs, items, opt).filter("edits = 0").collect()}
    assert got == brute(docs, items) and (0, 0) in got and (1, 1) in got and (2, 2) not in got


def test_changed_passages_are_mostly_found(spark):
    items = corpus(3, 60, 20)
    rng = random.Random(4)
    docs = []
    for t in items:
        w = t.split()
        for _ in range(1):
            w[rng.randrange(4, 16)] = "changed"
        docs.append(" ".join(w))
    found = {(r.item_id, r.doc_id) for r in run(spark, docs, items).filter("edits <= 1").collect()}
    assert sum((i, i) in found for i in range(60)) >= 54


def test_window_recall_at_every_place():
    """Windows of 13 words with 0, 1 and 2 edits; a window keeps its width after an edit."""
    rng, n, opt = np.random.default_rng(6), 400, L.Walks()
    base = rng.integers(0, 2**63, (n, opt.width), dtype=np.uint64)
    at = np.arange(n) * opt.width
    keys = L.signatures(base.ravel(), at, opt)

    def recall(*edits):
        rows = base.tolist()
        for w in rows:
            for kind, place in edits:
                if kind == "i":
                    w.insert(place, int(rng.integers(0, 2**63)))
                elif kind == "d":
                    w.pop(place)
                else:
                    w[place] = int(rng.integers(0, 2**63))
            w[:] = (w + rng.integers(0, 2**63, 2).tolist())[: opt.width]
        other = np.array(rows, dtype=np.uint64)
        near = L.edit_distance(base, other, opt.max_edits) <= opt.max_edits
        assert near.all()
        return (keys == L.signatures(other.ravel(), at, opt)).any(1).mean()

    places = range(opt.width)
    assert recall() == 1.0
    # An insertion or deletion pushes a word over the window's end: with it they are two edits.
    one = [recall((kind, p)) for kind in "sid" for p in places]
    two = [recall(("s", p), ("s", q)) for p in places for q in places if p < q] + [recall(("d", p), ("i", q)) for p in places for q in range(opt.width - 1)]
    assert min(one) >= 0.99 and min(two) >= 0.97 and np.mean(two) >= 0.99


def test_one_table_finds_exact_passages(spark):
    docs, items = corpus(1), corpus(2, 8, 30)
    docs[0] += " " + items[0]
    docs[1] += " " + " ".join(items[1].split()[5:18])
    got = {(r.item_id, r.doc_id) for r in run(spark, docs, items, L.EXACT).collect()}
    assert got == brute(docs, items) and {(0, 0), (1, 1)} <= got


def test_edit_distance_against_plain_dp():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (300, 7)), rng.integers(0, 3, (300, 9))
    b[:150, :7] = a[:150]
    b[:100, 3] = 9
    got = L.edit_distance(a, b, 2)
    for x, y, g in zip(a, b, got):
        d = np.arange(8)[:, None] + np.arange(10)[None, :]
        for i in range(1, 8):
            for j in range(1, 10):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
        assert g == min(d[7].min(), 3)  # the best beginning of the document's words


KINDS = ("s", "i", "d", "ss", "ii", "dd", "si", "sd", "id")


@pytest.mark.parametrize("opt", [L.Walks(), L.Walks(index_windows=0)], ids=["index", "joined"])
def test_recall_of_edited_passages_of_one_window(spark, opt):
    """Items of 13 words inside other text, with one or two edits of every kind at random places."""
    rng = random.Random(8)
    n = 120 if opt.index_windows else 30  # of each kind
    fresh = iter(range(10**9))
    new = lambda k: [f"n{next(fresh)}" for _ in range(k)]
    items, docs, kinds = [], [], []
    for i in range(n * len(KINDS)):
        kind = KINDS[i % len(KINDS)]
        w = new(13)
        items.append(" ".join(w))
        places = sorted(rng.sample(range(1, 13), len(kind)), reverse=True)
        for k, p in zip(kind, places):
            w[p : p + (k != "i")] = [] if k == "d" else new(1)
        docs.append(" ".join(new(5) + w + new(5)))
        kinds.append(kind)
    got = {r.item_id: r.edits for r in run(spark, docs, items, opt).filter("doc_id = item_id").collect()}
    for kind in KINDS:
        at = [i for i, k in enumerate(kinds) if k == kind]
        recall = np.mean([got.get(i, 9) <= len(kind) for i in at])
        assert recall >= 0.9, (kind, recall)


def test_filters_lose_no_pair_within_the_limit(spark):
    """All pairs of windows against plain edit distance: what the keys find is what is reported."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choice(vocab) for _ in range(14)) for _ in range(6)]
    docs = []
    for i in range(60):
        w = items[i % 6].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append(" ".join(w))
    index = {(r.doc_id, r.item_id): tuple(r) for r in run(spark, docs, items).collect()}
    joined = {(r.doc_id, r.item_id): tuple(r) for r in run(spark, docs, items, L.Walks(index_windows=0)).collect()}
    assert index == joined and len(index) > 30


def test_words_with_equal_hashes_are_told_apart(spark, monkeypatch):
    h = L.Hasher({5: "item"})
    import xxhash

    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w, seed=0: 5 if seed == 0 else real(w, seed))
    assert h["item"] == 5 and h["other"] != 5
