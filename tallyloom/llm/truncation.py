"""Texts that lost their end, and how often each source cuts.

A value is cut if one of these holds, the first that does is its rule:

- *copy*: it is a strict prefix of a longer value that goes on in the middle of the sentence. All
  distinct values and two probes for each suspect are sorted by range partitions; the next value
  after a probe is its longest-prefix successor, so one running window finds every longer copy;
- *mark*: it ends in an ellipsis, a replacement character or half an escape;
- *open*: it ends in a comma, colon, dash or inside brackets;
- *limit*: it ends without a stop exactly at a length at which its source piles up such values;
- *end*: its last words do not end a text. Counts over all values say how often the last three
  (else two, one) words are followed by a stop or the end of a value; a last word that never
  occurs inside a text is a piece of a word.

Only values without a final stop and values with a mark (without it) are sought as prefixes, and
only values without a final stop are suspects of the last two rules, so complete texts and complete
texts that merely lack the stop are no case. Nothing is joined pairwise. The named method is the
first rule; it can only find values of which a longer copy exists, the others find the rest.

Words are counted behind a table of bits of the suspects' last words, so only these are counted;
they are identified by 64-bit hashes of field and words.

Results for unusual input: null, empty and blank values and stubs are no case; null row ids and
null sources are kept as they are (a null source is a source). Repeated rows count once in the
result and once each in the rates. Texts of any length are read whole. Other columns are ignored.
An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.durable import durable
from tallyloom.llm.bits import bit_table, is_set


@dataclass(frozen=True)
class Ends:
    """``least_share``: share of endings among the occurrences of last words that may end a text.

    A pile has ``pile`` plus ``pile_sd`` standard deviations more values than the lengths around it.
    """

    least_share: float = 0.1
    support: int = 3
    pile: float = 2.0
    pile_sd: float = 5.0
    pile_window: int = 10


#: What stands for no text at all (without punctuation and case).
STUBS = ("na", "none", "null", "nil", "ok", "okay", "tbd", "unknown", "no", "yes", "same", "nochange", "nocomment", "nan", "missing", "todo", "test", "empty")
MARK = r"(?:…|\.\.\.|\x{FFFD}|\\u[0-9A-Fa-f]{0,3}|\\x[0-9A-Fa-f]?|\\)\s*$"
STOPS, CLOSERS, QUOTES = ".!?。！？", ")]\"”»", "'’"
ABBREVIATION = r"(?i)\b(?:e\.g|i\.e|cf|vs)\.$"
OPEN_ENDS = ",;:([{/&+=<–—-"
SPACES = " \t\n\r\x0b\x0c"
#: Longest ending that MARK and ABBREVIATION look at, with a character before it.
TAIL = 8


def signs(df: DataFrame) -> DataFrame:
    """Add what the value alone shows: stub, mark, open, suspect (no final stop)."""
    v = F.rtrim(F.col("value"), F.lit(SPACES))
    tail, last = F.right(v, F.lit(TAIL)), F.right(v, F.lit(1))
    before = F.right(F.rtrim(v, F.lit(CLOSERS + QUOTES)), F.lit(1))
    bare = lambda c: F.length(v) - F.length(F.replace(v, F.lit(c)))
    short = tail.rlike(ABBREVIATION)
    mark = tail.rlike(MARK)
    stop = (last.isin(*CLOSERS) | before.isin(*STOPS)) & ~short
    opened = last.isin(*OPEN_ENDS) | short | (v.contains("(") & (bare("(") > bare(")")))
    # Few letters or digits at all, and they spell a stub.
    longest = max(map(len, STUBS))
    few = ~v.rlike(r"(?:[\p{L}\p{N}][^\p{L}\p{N}]*){" + str(longest + 1) + "}")
    letters = F.regexp_replace(F.lower(v), r"[^\p{L}\p{N}]+", "")
    stub = F.when(few, (letters == "") | letters.isin(*STUBS)).otherwise(F.lit(False))
    return df.withColumns({"stub": stub, "__mark": mark, "__open": opened, "__stop": stop}).select(
        *df.columns, "stub", (~F.col("stub") & F.col("__mark")).alias("mark"),
        (~F.col("stub") & ~F.col("__mark") & F.col("__open") & ~F.col("__stop")).alias("open"),
        (~F.col("stub") & ~F.col("__mark") & ~F.col("__stop")).alias("suspect"),
    )


CODE_WORD, NUMBER, STOP_RUN = re.compile(r"\b[A-Z][A-Z0-9]*_A\b"), re.compile(r"\d+(?:[.,]\d+)*%?"), re.compile(r"[.!?。！？]+")
FOR_EXAMPLE = re.compile(r"(?i)\be\.g\.")
FINAL_MARK = re.compile(MARK.replace(r"\x{FFFD}", "\ufffd"))
TOKEN = re.compile(r"<end>|[\w'’-]+")
END, VALUE_END, BREAK = "<end>", "<eov>", "<break>"
#: Bits of the table of the suspects' last words.
GRAM_BITS = 26
REMEMBER = 500_000
#: Rows of counts (about 50 bytes each) that are broadcast; more are joined with a salt.
BROADCAST_ROWS = 200_000
SALTS = 16


def tokens(value: str, mark: bool = False) -> list[str]:
    """Lower-case words; variable codes and numbers are classes; a stop is ``<end>``.

    What stands before a mark of a cut is no ending and perhaps no word: mark and last word are left out.
    """
    t = FINAL_MARK.sub("", value) if mark else value
    if "_A" in t:
        t = CODE_WORD.sub(" codeword ", t)
    if ".g." in t or ".G." in t:
        t = FOR_EXAMPLE.sub(" eg ", t)
    t = STOP_RUN.sub(" <end> ", NUMBER.sub(" numword ", t).lower())
    found = TOKEN.findall(t)
    return found[:-1] if mark else found


class Words(dict):
    """64-bit numbers of words, remembered per worker."""

    def __missing__(self, word: str) -> int:
        import xxhash

        n = self[word] = xxhash.xxh64_intdigest(word)
        return n

    def __call__(self, found: list[str]) -> np.ndarray:
        if len(self) > REMEMBER:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def grams(h: np.ndarray, field: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n words that begin at each word but the last n - 1."""
    m = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        out = field[:m] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        for k in range(n):
            x = h[k : k + m]
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (x ^ (x >> np.uint64(32)))
        out ^= out >> np.uint64(31)
        return out * np.uint64(0x94D049BB133111EB)


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


LAST = "field_name string, value string, n long, i int, key long"


def _last_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the last 1, 2 and 3 words of suspects, as far as their last sentence has them."""
    words = Words()
    for b in batches:
        names, values, counts = (b.column(c).to_pylist() for c in ("field_name", "value", "n"))
        rows = []
        for f, v, n in zip(names, values, counts):
            t = tokens(v)[-3:]
            for i in range(1, len(t) + 1):
                if t[-i] == END:
                    break
                key = grams(words(t[-i:]), np.full(i, words[f or ""], dtype=np.uint64), i)
                rows.append((f, v, n, i, int(key.view(np.int64)[0])))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["field_name", "value", "n", "i", "key"])


COUNTS = "key long, inside long, stops long, ends long"


def _counter(table_var):
    """Per key of the table: how often a word, a stop, the end of a value follows; summed per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(), table_var.value
        special = np.array([words[w] for w in (END, VALUE_END, BREAK)], dtype=np.uint64)
        for b in batches:
            names, values, suspect, mark, n = (b.column(c).to_pylist() for c in ("field_name", "value", "suspect", "mark", "n"))
            lists = [tokens(v, m) + [VALUE_END if s else BREAK] for v, s, m in zip(values, suspect, mark)]
            size = np.array([len(t) for t in lists], dtype=np.int64)
            h = words([w for t in lists for w in t])
            field = np.repeat(np.array([words[f or ""] for f in names], dtype=np.uint64), size)
            weight = np.repeat(np.array(n, dtype=np.int64), size)
            kind = np.zeros(len(h), dtype=np.int8)
            for i, x in enumerate(special, 1):
                kind[h == x] = i
            keys, sums = [], []
            for n_words in (1, 2, 3):
                m = len(h) - n_words
                if m <= 0:
                    continue
                ok = np.ones(m, dtype=bool)
                for k in range(n_words):
                    ok &= kind[k : k + m] == 0
                after = kind[n_words : n_words + m]
                key = grams(h, field, n_words)[:m]
                at = np.flatnonzero(ok & (after < 3))
                at = at[is_set(table, _place(key[at])).astype(bool)]
                keys.append(key[at])
                sums.append(np.stack([weight[at] * (after[at] == j) for j in (0, 1, 2)], axis=1))
            if not keys:
                continue
            unique, back = np.unique(np.concatenate(keys), return_inverse=True)
            every = np.concatenate(sums)
            total = [np.bincount(back, every[:, j], len(unique)).astype(np.int64) for j in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), *map(pa.array, total)], names=["key", "inside", "stops", "ends"])

    return run


def ending_verdicts(texts: DataFrame, opt: Ends) -> DataFrame:
    """(field_name, value) of suspects whose last words do not end a text."""
    last = durable(texts.filter("suspect").select("field_name", "value", "n").mapInArrow(_last_words, LAST))
    table = bit_table(last.select("key"), lambda: lambda b: _place(b.column("key").to_numpy().view(np.uint64)), GRAM_BITS)
    held = texts.sparkSession.sparkContext.broadcast(table)
    counts = texts.select("field_name", "value", "suspect", "mark", "n").mapInArrow(_counter(held), COUNTS)
    counts = durable(counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("inside", "stops", "ends")]))
    if counts.count() <= BROADCAST_ROWS:
        judged = last.join(F.broadcast(counts), "key", "left")
    else:  # frequent endings are spread
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = last.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    seen, own = F.col("inside") + F.col("stops") + F.col("ends"), F.col("n")
    # The value itself does not count. A single word is confirmed by stops only: pieces of words
    # repeat at the ends of cut values.
    share = F.when(F.col("i") > 1, F.try_divide(F.col("stops") + F.col("ends") - own, seen - own)).otherwise(F.try_divide("stops", F.col("inside") + F.col("stops")))
    by_gram = judged.select(
        "field_name", "value",
        F.struct(
            # Long grams first, if others than this value have them.
            F.when((F.col("i") == 1) | (seen - own >= opt.support), F.col("i")).otherwise(F.lit(-1)).alias("order"),
            F.coalesce(share < opt.least_share, F.lit(True)).alias("unfinished"),
        ).alias("v"),
        F.when(F.col("i") == 1, F.coalesce(F.col("inside") + F.col("stops"), F.lit(0)) == 0).alias("fragment"),
    )
    verdict = by_gram.groupBy("field_name", "value").agg(F.max("v").alias("v"), F.max("fragment").alias("fragment"))
    return verdict.filter("fragment or (v.order >= 0 and v.unfinished)").select("field_name", "value")


def longer_copies(texts: DataFrame) -> DataFrame:
    """(field_name, value) of suspects with a longer copy that goes on inside the sentence."""
    rows = texts.select("field_name", F.col("value").alias("key"), F.col("value").alias("text"), F.lit(None).cast("string").alias("of"), F.lit(None).cast("string").alias("start"))
    # What follows in order begins with the value and a letter or digit, or a space and one.
    sus = texts.filter("suspect or mark").withColumn("start", F.when(F.col("mark"), F.regexp_replace("value", MARK, "")).otherwise(F.col("value")))
    for s in ("0", " 0"):
        rows = rows.unionByName(sus.select("field_name", F.concat("start", F.lit(s)).alias("key"), F.lit(None).cast("string").alias("text"), F.col("value").alias("of"), "start"))
    # Range partitions of distinct values are even whatever their prefixes; the cut fixes them.
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(rows.repartitionByRange(n, "field_name", "key").withColumn("bucket", F.spark_partition_id()))
    firsts = placed.filter("text is not null").groupBy("bucket").agg(F.min(F.struct("field_name", "text")).alias("f"))
    every = placed.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket")).join(firsts, "bucket", "left")
    later = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    following = every.select("bucket", F.last("f", ignorenulls=True).over(later).alias("f"))  # one row a partition
    w = Window.partitionBy("bucket").orderBy(F.col("field_name").desc(), F.col("key").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.when(F.col("text").isNotNull(), F.struct("field_name", "text"))
    near = placed.withColumn("next", F.last(entry, ignorenulls=True).over(w)).filter("of is not null").join(F.broadcast(following), "bucket", "left")
    nxt = F.coalesce("next", "f")
    rest = F.substring(nxt["text"], F.length("start") + 1, F.lit(3))
    ok = (nxt["field_name"] == F.col("field_name")) & (F.col("start") != "") & nxt["text"].startswith(F.col("start")) & rest.rlike(r"^ ?[\p{L}\p{N}_]")
    return near.filter(ok).select("field_name", F.col("of").alias("value")).distinct()


def limits(values: DataFrame, opt: Ends) -> DataFrame:
    """(field_name, source, len): lengths at which suspects of a source pile up."""
    h = values.filter("suspect or mark").groupBy("field_name", "source", F.length("value").alias("len")).agg(F.countDistinct("value").alias("n"))
    w = Window.partitionBy("field_name", "source").orderBy("len").rangeBetween(-opt.pile_window, opt.pile_window)
    around = (F.sum("n").over(w) - F.col("n")) / (2 * opt.pile_window)
    high = F.col("around") + opt.pile + opt.pile_sd * F.sqrt(F.col("around") + 0.5)
    return h.withColumn("around", around).filter(F.col("n") >= high).select("field_name", "source", "len")


def cut_values(values: DataFrame, opt: Ends = Ends()) -> DataFrame:
    """All values with their verdict.

    ``values``: src_table, row_id, field_name, source, value. Adds ``cut`` and ``rule`` (the first
    rule that holds; null for a complete value).
    """
    rows = durable(signs(values.filter(F.col("value").isNotNull() & (F.trim("value") != ""))))
    texts = rows.groupBy("field_name", "value").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("suspect", "stub", "mark")])
    texts = durable(texts.filter("not stub").drop("stub"))
    verdict = ending_verdicts(texts, opt).withColumn("bad_end", F.lit(True))
    verdict = verdict.join(longer_copies(texts).withColumn("has_copy", F.lit(True)), ["field_name", "value"], "full")
    found = rows.filter("suspect or mark").join(verdict, ["field_name", "value"], "left")
    at = limits(rows, opt).select(F.col("field_name").alias("f"), F.col("source").alias("s"), "len", F.lit(True).alias("at_limit"))
    found = found.join(at, F.expr("field_name = f and source <=> s and length(value) = len"), "left").drop("f", "s", "len")
    rule = (
        F.when(F.col("has_copy"), "copy").when(F.col("mark"), "mark").when(F.col("open"), "open")
        .when(F.col("suspect") & F.col("at_limit"), "limit").when(F.col("bad_end"), "end")
    )
    keep = ["src_table", "row_id", "field_name", "source", "value"]
    sure = rows.filter("not (suspect or mark)").select(*keep, F.lit(None).cast("string").alias("rule"))
    return found.select(*keep, rule.alias("rule")).unionByName(sure).withColumn("cut", F.col("rule").isNotNull())


def rates(judged: DataFrame) -> DataFrame:
    """Per source and field: values, cut values, rate, and the rules that found them."""
    return judged.groupBy("src_table", "field_name", "source").agg(
        F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_rate"),
        *[F.count_if(F.col("rule") == r).alias(f"by_{r}") for r in ("copy", "mark", "open", "limit", "end")],
    )
