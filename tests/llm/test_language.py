import random

import numpy as np
import pytest

from tallyloom.llm import language as G

WORDS = {
    "en": "the clinic said that a visit was late because nobody had called when patient asked about winter doses with them".split(),
    "es": "la clínica dijo que una visita era tarde porque nadie había llamado cuando paciente preguntó sobre dosis del invierno con ellos".split(),
    "de": "die Praxis sagte dass ein Besuch spät war weil niemand angerufen hatte als Patient nach Dosen im Winter mit ihnen fragte".split(),
    "zh": list("诊所说访问晚了因为没有人打电话病人问冬天剂量"),
}


def sentence(rng, lang, n=9):
    w = [rng.choice(WORDS[lang]) for _ in range(n)]
    return ("".join(w) + "。") if lang == "zh" else " ".join(w).capitalize() + "."


def text(rng, *langs):
    return " ".join(sentence(rng, x) for x in langs)


def corpus(seed=0, n=240):
    rng = random.Random(seed)
    rows, truth = [], {}
    langs = list(WORDS)
    for i in range(n):
        a, b = langs[i % 4], langs[(i + 1 + i // 4 % 3) % 4]
        kind = i % 12
        t = text(rng, *[a] * 4)
        label, of = a, {a}
        if kind == 5:
            label = b
        elif kind == 7:
            label = rng.choice(["", None, "und", "xx"])
        elif kind == 9:
            t, of = text(rng, a, a, a, b, b), {a, b}
        elif kind == 10:
            t = t[:-1] + f" ({' '.join(WORDS[b][:3])})."
        elif kind == 11:
            label = {"en": "English", "es": "es-MX", "de": "deu", "zh": "zh_CN"}[a]
        rows.append((i, label, t, a))
        if kind in (5, 7, 9):
            truth[i] = of
    return rows, truth


SCHEMA = "doc_id long, lang string, text string, lang_code string"


def test_found_documents_and_segments(spark):
    rows, truth = corpus()
    s = G.segments(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    got = {}
    for r in s:
        if r.of_document and r.needs_label:
            got.setdefault(r.doc_id, set()).add(r.lang_code)
    agree = sum(got.get(i) == truth.get(i) for i in range(len(rows)))
    assert agree >= 0.98 * len(rows)
    assert all(0 < r.confidence <= 1.000001 for r in s)
    mixed = [r for r in s if rows[r.doc_id][0] % 12 == 9]
    assert np.mean([rows[r.doc_id][2][r.start : r.end].strip() != "" for r in mixed]) == 1.0
    assert sum(r.n_sentences for r in mixed) == 5 * len({r.doc_id for r in mixed})


def test_label_spellings():
    good = {"en": "EN eng english en-US en_GB English", "es": "Spanish es-MX spa Castilian", "fr": "fra fre fr_CA French", "zh": "zh-CN chinese zho", "pt": "pt-BR Portuguese"}
    assert all(G.label_code(x) == c for c, xs in good.items() for x in xs.split())
    assert [G.label_code(x) for x in ("und", "xx", "", None, "mul", "unknown", " ")] == [None] * 7


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, tr = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    g, pairs = G.forward_backward(e, lengths, tr, pairs=True)
    want_pairs = np.zeros((3, 3))
    for b, n in enumerate(lengths):
        paths = list(np.ndindex(*[3] * n))
        w = np.array([np.exp(sum(e[b, i, y[i]] for i in range(n)) + sum(tr[y[i], y[i + 1]] for i in range(n - 1))) for y in paths])
        w /= w.sum()
        for i in range(n):
            want = [sum(p for p, y in zip(w, paths) if y[i] == k) for k in range(3)]
            assert g[b, i] == pytest.approx(want)
        for p, y in zip(w, paths):
            for i in range(n - 1):
                want_pairs[y[i], y[i + 1]] += p
    assert pairs == pytest.approx(want_pairs)


def test_chains_keep_every_word_and_whole_sentences():
    chains = G._chains([3, 5000, 1, 700, 900], 1000)
    assert chains == [(0, 3), (3, 5003), (5003, 5704), (5704, 6604)] and G._chains([], 9) == []


def test_segments_inside_sentences(spark):
    rows, _ = corpus()
    rng = random.Random(9)
    texts = []
    for a, b in (("en", "es"), ("de", "en"), ("es", "de")):
        left, right = " ".join(rng.choice(WORDS[a]) for _ in range(9)), " ".join(rng.choice(WORDS[b]) for _ in range(8))
        texts.append((a, b, left, f"{sentence(rng, a)} {left} {right} {rng.choice(WORDS[a])} {left}. {sentence(rng, a)}"))
    df = spark.createDataFrame(rows + [(1000 + i, a, t, "") for i, (a, _, _, t) in enumerate(texts)], SCHEMA)
    got = {}
    for r in G.segments(spark, df).filter("doc_id >= 1000").orderBy("doc_id", "segment").collect():
        got.setdefault(r.doc_id - 1000, []).append(r)
    for i, (a, b, left, t) in enumerate(texts):
        segs = got[i]
        assert [r.lang_code for r in segs] == [a, b, a]
        assert abs(segs[1].start - (t.index(left) + len(left) + 1)) <= 12 and segs[1].n_sentences == 0 and segs[1].confidence > 0.6
        assert [segs[k].end for k in (0, 1)] == [segs[k].start for k in (1, 2)] and not segs[1].of_document and not segs[0].needs_label


def test_languages_that_were_not_learned_are_unknown(spark):
    rows, _ = corpus()
    da = "Klinikken sagde, at besøget blev forsinket, fordi ingen havde ringet. Patienten spurgte hvorfor sygehuset ikke længere åbner om lørdagen, og lægen svarede at der manglede hjælp."
    df = spark.createDataFrame(rows + [(1000, "da", da, ""), (1001, "de", da, ""), (1002, "en", rows[0][2] + " " + da, "")], SCHEMA)
    got = {}
    for r in G.segments(spark, df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {r.lang_code for r in got[1000]} == {r.lang_code for r in got[1001]} == {G.UNKNOWN}
    assert {r.lang_code for i in got if i < 1000 for r in got[i]} == set(WORDS)
    assert {r.lang_code for r in got[1002]} == {rows[0][3], G.UNKNOWN}


def test_labels_of_all_languages(spark):
    codes = G.label_codes(spark)
    for label, want in {"Danish": "da", "dan": "da", "da-DK": "da", "Ελληνικά": "el", "greek": "el", "ger": "de", "Swahili": "sw", "swa": "sw", "fin_FI": "fi"}.items():
        assert G.label_code(label, codes) == want
    assert [G.label_code(x, codes) for x in ("und", "xx", "", None, "mul", "unknown", " ")] == [None] * 7


def test_long_tags_and_sentences_are_read_whole(spark):
    rows, _ = corpus()
    tag = f"<div style='{'en clinique dit que ' * 40}'>"
    long = " ".join(random.Random(2).choice(WORDS["de"]) for _ in range(6000))
    df = spark.createDataFrame(rows + [(1000, "es", tag + rows[1][2], ""), (1001, "de", long, "")], SCHEMA)
    got = {r.doc_id: r for r in G.segments(spark, df).filter("doc_id >= 1000").collect()}
    assert got[1000].lang_code == rows[1][3] and got[1000].n_words < 60
    assert got[1001].lang_code == "de" and got[1001].n_words == 6000


def test_edges(spark):
    rows, _ = corpus(1, 48)
    odd = [(900, "en", None, ""), (901, "en", "", ""), (902, "en", "12345 67 !!", ""), (None, "en", rows[0][2], ""), (903, "en", " ".join([rows[0][2]] * 2000), ""), (904, None, rows[0][2], ""), (904, None, rows[0][2], "")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    got = G.segments(spark, df).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {900, 901, 902, None} and {903, 904} <= ids
    assert G.segments(spark, df.filter("false")).count() == 0
    assert G.segments(spark, df.filter("lang is null")).count() == 0
