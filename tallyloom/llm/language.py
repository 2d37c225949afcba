"""Language of documents and of their segments, by a linear-chain conditional random field.

Words are labelled with languages. The features of a word are hashed affixes, character n-grams,
the word itself, its shape, and its entries in lexicons built from the training sample; the
transitions between languages are learned. Forward-backward gives each word a distribution over
languages, the mean over a sentence gives the sentence's language and confidence. Segments are
runs of words of one language: sentences of one language are put together, and ``Rules.phrase`` or
more words of another language inside a sentence are a segment of their own.

Training takes a bounded sample (``Training.docs`` documents per language, chosen by a hash of the
id) of documents whose label can be read. Labels may be wrong and documents mixed: a first field
is fitted on all of them, sentences that it places in another language than their label are left
out, and the final field is fitted on sequences put together from the others, with switches
between sentences and short foreign phrases inside them. All documents are then labelled. The
table is read for ids and labels (to find how many documents a language has), for the sample, and
for the labelling.

A language is one of a document's if at least ``Rules.sentences`` whole sentences are in it, or if
it is the language of most of its words. Sentences, together ``Rules.least_unknown`` or more words,
whose letter sequences are far less likely in their language than almost all sentences of the
training documents are in a language that was not learned, ``und``; so is a document of them.

Results for unusual input: null or blank texts and texts without letters give no rows; null ids
are dropped. Texts and sentences of any length are read whole (chains end at sentence ends
only). Repeated texts are labelled each. Other columns are ignored. Empty tables give an empty
table; without any readable label there are no languages and no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.ranked import unit_hash


@dataclass(frozen=True)
class Training:
    docs: int = 300
    chars: int = 4000
    least_docs: int = 3
    buckets: int = 2**17
    epochs: int = 3
    sequences: int = 4000
    batch: int = 48
    rate: float = 0.04
    l2: float = 1e-6
    seed: int = 3


@dataclass(frozen=True)
class Rules:
    sentences: int = 2
    least_words: int = 4
    least_confidence: float = 0.6
    chain: int = 1500  # words after which a chain ends with the sentence
    phrase: int = 3
    least_unknown: int = 12


#: Code of a language that was not learned (ISO 639-2, undetermined).
UNKNOWN = "und"
#: Usual spellings of language labels (codes and names), by two-letter code. The codes
#: and English names of all other languages come from :func:`label_codes`.
SPELLINGS = {
    "en": "en eng english",
    "es": "es spa esp spanish castilian espanol español castellano",
    "fr": "fr fra fre french francais français",
    "de": "de deu ger german deutsch",
    "pt": "pt por portuguese portugues português",
    "it": "it ita italian italiano",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語",
    "ko": "ko kor korean 한국어",
    "ar": "ar ara arabic العربية",
    "pl": "pl pol polish polski",
    "tr": "tr tur turkish",
    "vi": "vi vie vietnamese",
    "sv": "sv swe swedish",
}
CODE = {s: c for c, names in SPELLINGS.items() for s in names.split()}

TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
NOISE = re.compile(r"https?://\S+|\S+@\S+|\b[A-Z0-9]+_[A-Z0-9_]+\b")
BREAK = re.compile(r"[.!?]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[”」』]*|[\r\n]+|</?[A-Za-z!][^<>]*>")
WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*")
REMEMBER = 300_000


def label_codes(spark: SparkSession) -> dict[str, str]:
    """Spelling to two-letter code: codes, three-letter codes, English and own names of all languages
    of ISO 639 that the Java runtime knows, and ``SPELLINGS``."""
    locale = spark._jvm.java.util.Locale
    out: dict[str, str] = {}
    for code in locale.getISOLanguages():
        one = locale.forLanguageTag(code)
        for name in (one.getISO3Language(), one.getDisplayLanguage(locale.ENGLISH), one.getDisplayLanguage(one), code):
            if name:
                out[name.lower()] = code
    return out | CODE


def label_code(label: str | None, codes: dict[str, str] = CODE) -> str | None:
    """Two-letter code of a label in a usual spelling (code, region variant, English name)."""
    if not label:
        return None
    s = label.strip().lower()
    return codes.get(s) or codes.get(re.split(r"[-_ (;,]", s)[0])


def _clean(part: str, blank) -> str:
    if "<" in part:
        part = TAG.sub(blank, part)
    if "@" in part or "_" in part or "http" in part:
        part = NOISE.sub(blank, part)
    return part


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences that have words."""
    start = 0
    for m in [*BREAK.finditer(text), None]:
        end = m.end() if m else len(text)
        found = WORD.findall(_clean(text[start:end], " "))
        if found:
            yield start, end, found
        start = end


def word_places(part: str) -> list[tuple[int, int]]:
    """(start, end) of the words of a sentence."""
    return [m.span() for m in WORD.finditer(_clean(part, lambda m: " " * len(m.group())))]


def features(word: str, mask: int) -> list[int]:
    """Hashed affix, n-gram, word and shape features."""
    import xxhash

    w = word.lower().replace("’", "'")
    s = f"^{w}$"
    names = [f"w{w}", f"c{word[:1].isupper()}", f"l{min(len(w), 8)}"]
    names += [f"p{w[:k]}" for k in range(1, min(3, len(w)) + 1)] + [f"s{w[-k:]}" for k in range(1, min(4, len(w)) + 1)]
    names += [f"b{s[i : i + 2]}" for i in range(len(s) - 1)] + [f"t{s[i : i + 3]}" for i in range(len(s) - 2)]
    return [xxhash.xxh32_intdigest(n) & mask for n in dict.fromkeys(names)]


def forward_backward(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Word marginals (and summed pair marginals) of a padded batch of chains.

    ``e``: scores (chains x steps x labels), ``trans``: (from x to) scores.
    """
    b, t, n = e.shape
    p, tr = np.exp(e - e.max(2, keepdims=True)), np.exp(trans - trans.max())
    live = np.arange(t)[None, :] < lengths[:, None]
    a, z = np.empty_like(p), np.ones((b, t))
    a[:, 0] = p[:, 0]
    for i in range(t):
        if i:
            a[:, i] = (a[:, i - 1] @ tr) * p[:, i]
        z[:, i] = a[:, i].sum(1)
        a[:, i] /= z[:, i, None]
    beta = np.ones_like(p)
    for i in range(t - 2, -1, -1):
        nxt = (beta[:, i + 1] * p[:, i + 1]) @ tr.T / z[:, i + 1, None]
        beta[:, i] = np.where(live[:, i + 1, None], nxt, 1.0)
    gamma = a * beta
    gamma /= gamma.sum(2, keepdims=True)
    if not pairs:
        return gamma
    both = live[:, 1:]
    left = a[:, :-1][both]
    right = (beta[:, 1:] * p[:, 1:] / z[:, 1:, None])[both]
    return gamma, tr * (left.T @ right)


class Rows(dict):
    """Row numbers of words; words met for the first time wait in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


#: Buckets of the letter sequences that tell known from unknown languages.
LETTERS = 2**15


def letters(word: str) -> list[int]:
    import xxhash

    s = f"^{word.lower()}$"
    return [xxhash.xxh32_intdigest(s[i : i + 3]) & (LETTERS - 1) for i in range(max(1, len(s) - 2))]


class Field:
    """A linear-chain field over hashed word features."""

    def __init__(self, langs: list[str], lexicon: dict[str, int], opt: Training) -> None:
        self.langs, self.lexicon, self.opt = langs, lexicon, opt
        n = len(langs)
        self.w = np.zeros((opt.buckets + n + 1, n), dtype=np.float32)
        self.trans = np.eye(n) * 2.0
        self.letters = np.zeros((LETTERS, n), dtype=np.float32)
        self.bounds = np.full(n, -np.inf)
        self.forget()

    def forget(self) -> None:
        self.seen, self.scores = Rows(), np.empty((0, 2 * len(self.langs)), dtype=np.float32)

    def ids(self, word: str) -> list[int]:
        lex = self.lexicon.get(word.lower(), len(self.langs))
        return [*features(word, self.opt.buckets - 1), self.opt.buckets + lex]

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Scores of words (labels), then how likely their letters are in each language; those of a
        word are computed once per worker."""
        if len(self.seen) > REMEMBER:
            self.forget()
        at = np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))
        if self.seen.new:
            new = [np.concatenate([self.w[self.ids(w)].sum(0), self.letters[letters(w)].mean(0)]) for w in self.seen.new]
            self.scores = np.concatenate([self.scores, np.stack(new)])
            self.seen.new = []
        return self.scores[at]

    def learn_letters(self, kept: dict[int, list[list[str]]]) -> None:
        """Letter sequences of each language, and a bound far below almost all of its sentences."""
        n = len(self.langs)
        count = np.full((LETTERS, n), 0.05)
        for y, parts in kept.items():
            for w, c in Counter(x for p in parts for x in p).items():
                np.add.at(count[:, y], letters(w), np.log1p(c))
        self.letters = np.log(count / count.sum(0)).astype(np.float32)
        self.forget()
        for y, parts in kept.items():
            got = np.array([self.rows(w)[:, n + y].mean() for w in parts if len(w) >= 6])
            if len(got) >= 20:
                low, mid = np.quantile(got, [0.02, 0.5])
                self.bounds[y] = low - 1.5 * (mid - low)

    def fit(self, sequences: list[tuple[list[str], list[int]]], chained: bool = True) -> "Field":
        """Gradient steps with running scales on the log likelihood of labelled sequences.

        ``chained=False`` keeps all transitions equal: words are learned independently, so that
        certain neighbours cannot make up for weak word scores.
        """
        if not chained:
            self.trans[:] = 0.0
        opt, n = self.opt, len(self.langs)
        vocab = {w: i for i, w in enumerate(dict.fromkeys(w for s, _ in sequences for w in s))}
        lists = [self.ids(w) for w in vocab]
        ptr = np.cumsum([0, *map(len, lists)])
        flat = np.array([i for x in lists for i in x], dtype=np.int64)
        toks = [np.array([vocab[w] for w in s]) for s, _ in sequences]
        labels = [np.array(y) for _, y in sequences]
        g_w, g_t = np.full(self.w.shape, 1e-4, dtype=np.float32), np.full(self.trans.shape, 1e-2)
        rng = np.random.default_rng(opt.seed)
        for epoch in range(opt.epochs):
            order, step = rng.permutation(len(toks)), opt.rate / (1 + epoch)
            for s in range(0, len(order), opt.batch):
                pick = order[s : s + opt.batch]
                lengths = np.array([len(toks[i]) for i in pick])
                live = np.arange(lengths.max())[None, :] < lengths[:, None]
                words, where = np.unique(np.concatenate([toks[i] for i in pick]), return_inverse=True)
                size = ptr[words + 1] - ptr[words]
                at = np.repeat(ptr[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                ids, owner = flat[at], np.repeat(np.arange(len(words)), size)
                score = np.add.reduceat(self.w[ids], np.cumsum(size) - size, axis=0)
                e = np.zeros((len(pick), lengths.max(), n))
                e[live] = score[where]
                gamma, pair = forward_backward(e, lengths, self.trans, pairs=True)
                y = np.concatenate([labels[i] for i in pick])
                d = -gamma[live]
                d[np.arange(len(y)), y] += 1.0
                per_word = np.zeros((len(words), n))
                np.add.at(per_word, where, d)
                used, back = np.unique(ids, return_inverse=True)
                grad = np.stack([np.bincount(back, per_word[owner, k], len(used)) for k in range(n)], axis=1) / len(y)
                grad -= opt.l2 * self.w[used]
                g_w[used] = 0.9 * g_w[used] + 0.1 * grad**2
                self.w[used] += step * grad / np.sqrt(g_w[used] + 1e-12)
                count = np.zeros((n, n))
                for i in pick:
                    np.add.at(count, (labels[i][:-1], labels[i][1:]), 1.0)
                if chained:
                    dt = (count - pair) / len(y)
                    g_t = 0.9 * g_t + 0.1 * dt**2
                    self.trans += step * dt / np.sqrt(g_t + 1e-12)
        self.forget()
        return self

    def marginals(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Distribution over languages of each word of each chain of word scores."""
        out: list = [None] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and (e - s + 1) * len(chains[order[e]]) <= 60_000:
                e += 1
            pick = order[s:e]
            lengths = np.array([len(chains[i]) for i in pick])
            x = np.zeros((len(pick), lengths.max(), len(self.langs)), dtype=np.float32)
            live = np.arange(lengths.max())[None, :] < lengths[:, None]
            x[live] = np.concatenate([chains[i] for i in pick])
            g = forward_backward(x, lengths, self.trans)
            for k, i in enumerate(pick):
                out[i] = g[k, : lengths[k]]
            s = e
        return out


def _chains(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """(from, to) of chains of whole sentences, which end with the first sentence beyond the limit."""
    out, start, at = [], 0, 0
    for n in sizes:
        if at > start and at + n - start > limit:
            out.append((start, at))
            start = at
        at += n
    return [*out, (start, at)] if at > start else out


def label_words(field: Field, docs: list[list[tuple[int, int, list[str]]]], rules: Rules):
    """Per document: (language, confidence) of every sentence, and the phrases in other languages
    inside sentences as {sentence: [(from word, to word, language, confidence)]}."""
    n = len(field.langs)
    rows = field.rows([w for parts in docs for _, _, words in parts for w in words])
    sizes = [[len(w) for _, _, w in parts] for parts in docs]
    chains, at = [], 0
    for own in sizes:
        chains += [rows[at + a : at + b, :n] for a, b in _chains(own, rules.chain)]
        at += sum(own)
    if not at:
        return [[] for _ in docs], [{} for _ in docs]
    every = np.concatenate(field.marginals(chains))
    size = np.array([m for own in sizes for m in own])
    first = np.cumsum(size) - size
    sums = np.add.reduceat(every, first, axis=0)
    mean = sums / size[:, None]
    best = mean.argmax(1)
    # Words of a language other than their sentence's, in runs of at least ``phrase``.
    word = every.argmax(1)
    sentence = np.repeat(np.arange(len(size)), size)
    other = word != best[sentence]
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (sentence[1:] != sentence[:-1])])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(word)))
    inside: dict[int, list] = {}
    for a, m in zip(begin[other[begin] & (length >= rules.phrase)], length[other[begin] & (length >= rules.phrase)]):
        k, conf = int(word[a]), float(every[a : a + m, word[a]].mean())
        if conf >= rules.least_confidence:
            i = int(sentence[a])
            inside.setdefault(i, []).append((int(a - first[i]), int(a - first[i] + m), k, conf))
    # The confidence of a sentence is that of its own words.
    conf = mean[np.arange(len(size)), best]
    for i, parts in inside.items():
        out = np.ones(size[i], dtype=bool)
        for a, b, _, _ in parts:
            out[a:b] = False
        if out.any():
            conf[i] = every[first[i] : first[i] + size[i]][out][:, best[i]].mean()
    # Sentences whose letters are too unlikely in their language, without the phrases inside them.
    own_word = np.ones(len(word), dtype=bool)
    for i, parts in inside.items():
        for a, b, _, _ in parts:
            own_word[first[i] + a : first[i] + b] = False
    likely = np.add.reduceat(np.where(own_word, rows[np.arange(len(word)), n + best[sentence]], 0.0), first)
    short = field.bounds[best] - likely / np.maximum(np.add.reduceat(own_word.astype(np.int64), first), 1)
    owner = np.repeat(np.arange(len(docs)), [len(own) for own in sizes])
    strange = short > 0
    start = np.flatnonzero(np.concatenate([[True], (strange[1:] != strange[:-1]) | (owner[1:] != owner[:-1])]))
    for r in np.flatnonzero(strange[start] & (np.add.reduceat(size, start) >= rules.least_unknown)):
        at = slice(start[r], start[r + 1] if r + 1 < len(start) else len(size))
        best[at], conf[at] = n, 1 - np.exp(-short[at])
        for i in range(at.start, at.stop):
            inside.pop(i, None)
    marks, phrases, at = [], [], 0
    for own in sizes:
        marks.append(list(zip(best[at : at + len(own)].tolist(), conf[at : at + len(own)].tolist())))
        phrases.append({i: inside[at + i] for i in range(len(own)) if at + i in inside} if inside else {})
        at += len(own)
    return marks, phrases


def label_sentences(field: Field, docs: list[list[tuple[int, int, list[str]]]], rules: Rules) -> list[list[tuple[int, float]]]:
    """(language, confidence) of every sentence of every document."""
    return label_words(field, docs, rules)[0]


def train(rows: list[tuple[str, str]], opt: Training = Training(), rules: Rules = Rules()) -> Field:
    """A field from (text, language code) rows with partly wrong labels.

    The first field is fitted on all of them, the final one on ``opt.sequences`` sequences.
    """
    have = Counter(c for _, c in rows)
    langs = sorted(c for c, n in have.items() if n >= opt.least_docs)
    number = {c: i for i, c in enumerate(langs)}
    docs = [(list(sentences(t)), number[c]) for t, c in rows if c in number]
    docs = [(p, y) for p, y in docs if p]
    if not docs:
        return Field([], {}, opt)

    def lexicon(parts: list[tuple[list[str], int]]) -> dict[str, int]:
        seen: dict[str, Counter] = {}
        size = Counter()
        for w, y in parts:
            for x in w:
                seen.setdefault(x.lower(), Counter())[y] += 1
            size[y] += len(w)
        out = {}
        for w, c in seen.items():
            share = {y: n / size[y] for y, n in c.items()}
            y = max(share, key=share.get)
            if c[y] >= 3 and share[y] >= 0.9 * sum(share.values()):
                out[w] = y
        return out

    first = Field(langs, lexicon([(w, y) for p, y in docs for _, _, w in p]), opt)
    joined = [([w for _, _, ws in p for w in ws], y) for p, y in docs]
    first.fit([(w[a:b], [y] * (b - a)) for (p, y), (w, _) in zip(docs, joined) for a, b in _chains([len(x) for _, _, x in p], 120)], chained=False)
    kept: dict[int, list[list[str]]] = {y: [] for y in range(len(langs))}
    for (parts, y), marks in zip(docs, label_sentences(first, [p for p, _ in docs], rules)):
        good = [w for (_, _, w), (k, _) in zip(parts, marks) if k == y]
        if 2 * len(good) > len(parts):
            kept[y].extend(good)
    # Sequences of several sentences: most stay in a language, some switch, some hold a phrase.
    rng = np.random.default_rng(opt.seed)
    pool = [(w, y) for y, ws in kept.items() for w in ws]
    able = [y for y in kept if kept[y]]
    sequences = []
    for at in rng.permutation(len(pool))[: opt.sequences]:
        w, y = pool[at]
        words, labels = list(w), [y] * len(w)
        for _ in range(2):
            if rng.random() < 0.25:
                y = able[rng.integers(len(able))]
            more = kept[y][rng.integers(len(kept[y]))]
            tags = [y] * len(more)
            if rng.random() < 0.15 and len(more) > 4:
                other = able[rng.integers(len(able))]
                src = kept[other][rng.integers(len(kept[other]))]
                a = rng.integers(len(src))
                phrase = src[a : a + rng.integers(2, 5)]
                i = rng.integers(1, len(more))
                more = [*more[:i], *phrase, *more[i:]]
                tags = [*tags[:i], *[other] * len(phrase), *tags[i:]]
            words, labels = words + list(more), labels + tags
        sequences.append((words[:150], labels[:150]))
    final = Field(langs, lexicon(pool), opt)
    final.w[:] = first.w
    final.fit(sequences)
    final.learn_letters(kept)
    return final


SEGMENTS = (
    "doc_id long, segment int, lang_code string, confidence double, n_sentences int, n_words int, start int, end int,"
    " of_document boolean, document_confidence double, needs_label boolean"
)


def document_languages(parts, marks, langs: list[str], rules: Rules) -> dict[int, float]:
    """Languages of a document with their confidence: the main one and those with whole sentences."""
    words, whole, conf = Counter(), Counter(), {}
    for (_, _, w), (k, c) in zip(parts, marks):
        words[k] += len(w)
        conf.setdefault(k, []).append((c, len(w)))
        if len(w) >= rules.least_words and c >= rules.least_confidence:
            whole[k] += 1
    main = max(words, key=lambda k: (words[k], whole[k], -k))
    kept = {k for k, n in whole.items() if n >= rules.sentences}
    # Where other languages have whole sentences but the one of most words hasn't, it isn't one.
    kept = kept or {main}
    return {k: sum(c * n for c, n in conf[k]) / sum(n for _, n in conf[k]) for k in kept}


def _pieces(text: str, parts, marks, phrases) -> Iterator[tuple[int, float, int, int, int, int]]:
    """(language, confidence, sentences, words, start, end) of sentences and of phrases inside them."""
    for i, ((a, b, w), (k, c)) in enumerate(zip(parts, marks)):
        if i not in phrases:
            yield k, c, 1, len(w), a, b
            continue
        spans, at, begin, count = word_places(text[a:b]), 0, a, 1
        for lo, hi, other, conf in phrases[i]:
            if lo > at:
                yield k, c, count, lo - at, begin, a + spans[lo][0]
                count = 0
            end = a + spans[hi][0] if hi < len(spans) else b
            yield other, conf, 0, hi - lo, a + spans[lo][0] if lo > at or at else begin, end
            at, begin = hi, end
        if at < len(w):
            yield k, c, count, len(w) - at, begin, b


def _label(model, codes, rules: Rules):
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.setdefault("field", model.value)
        names = [*field.langs, UNKNOWN]
        for batch in batches:
            ids, given, texts = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))
            docs = [list(sentences(t)) for t in texts]
            rows = []
            for i, text, parts, marks, phrases, label in zip(ids, texts, docs, *label_words(field, docs, rules), given):
                if not parts:
                    continue
                of = document_languages(parts, marks, names, rules)
                needs = len(of) > 1 or label_code(label, codes) != names[next(iter(of))]
                runs: list[list] = []
                for k, c, n, m, a, b in _pieces(text, parts, marks, phrases):
                    if runs and runs[-1][0] == k:
                        r = runs[-1]
                        r[1] += c * m
                        r[2] += n
                        r[3] += m
                        r[5] = b
                    else:
                        runs.append([k, c * m, n, m, a, b])
                for s, (k, c, n, m, a, b) in enumerate(runs):
                    rows.append((i, s, names[k], c / m, n, m, a, b, k in of, of.get(k), needs))
            cols = list(zip(*rows)) if rows else [[]] * 11
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), *[pa.int32()] * 4, pa.bool_(), pa.float64(), pa.bool_()]
            names_ = [x.split()[0] for x in SEGMENTS.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names_)

    return run


def training_rows(spark: SparkSession, documents: DataFrame, opt: Training = Training()) -> list[tuple[str, str]]:
    """At most ``opt.docs`` documents per language with a readable label, first ``opt.chars`` characters.

    Labels are counted without reading texts; the counts say how small the hash of an id must be.
    """
    codes = label_codes(spark)
    table = F.broadcast(spark.createDataFrame(list(codes.items()), "label string, code string"))  # the spellings above
    raw = documents.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).withColumn("label", F.lower(F.trim("lang")))
    part = F.element_at(F.split("label", r"[-_ (;,]", 2), 1)
    coded = raw.join(table, "label", "left").withColumn("part", part)
    coded = coded.join(table.select(F.col("label").alias("part"), F.col("code").alias("part_code")), "part", "left")
    coded = coded.withColumn("code", F.coalesce("code", "part_code")).filter("code is not null")
    counts = coded.groupBy("code").count().collect()  # one row a language
    if not counts:
        return []
    # A third more than wanted, as some texts are blank; what is over is cut off below.
    rates = spark.createDataFrame([(r["code"], (opt.docs * 4 / 3 + 20) / r["count"]) for r in counts], "code string, rate double")
    u = unit_hash(opt.seed, "doc_id")
    chosen = coded.withColumn("u", u).join(F.broadcast(rates), "code").filter((F.col("u") < F.col("rate")) & (F.trim("text") != ""))
    got = sorted((r["code"], r["u"], r["text"]) for r in chosen.select("code", "u", F.left("text", F.lit(opt.chars)).alias("text")).collect())
    seen: Counter = Counter()
    out = []
    for code, _, text in got:
        seen[code] += 1
        if seen[code] <= opt.docs:
            out.append((text, code))
    return out


def segments(spark: SparkSession, documents: DataFrame, opt: Training = Training(), rules: Rules = Rules()) -> DataFrame:
    """All segments of all documents; ``of_document`` marks languages that count as the document's.

    ``needs_label``: the label is missing, no language or another one, or the text is mixed.
    """
    field = train(training_rows(spark, documents, opt), opt, rules)
    docs = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    if not field.langs:
        docs = docs.limit(0)
    return docs.mapInArrow(_label(spark.sparkContext.broadcast(field), label_codes(spark), rules), SEGMENTS)
