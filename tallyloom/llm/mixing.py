"""Mixing sources to target shares of the total size in tokens, by Pareto order sampling.

Sizes are token counts of a public tokenizer whose vocabulary file is a parameter. A source's
budget is ``target_share * budget_fraction * size of all documents``. A document's expected
number of copies is ``rate * weight``, at most ``max_repeats``, with the rate at which the expected
size of the source meets its budget: what capped documents cannot take goes to the others. All
weights are 1 unless a column ``weight`` is given; weights are rounded to three digits, so their
number is bounded. A document's whole copies are certain; the rest is the inclusion probability of
one more copy. Documents are ranked by random odds ``u / (1 - u)`` divided by inclusion odds
``p / (1 - p)`` and taken in that order until the remaining budget is met (a Pareto sample).

A source falls short if every one of its documents was drawn ``max_repeats`` times and its budget
is still not met.

Results for unusual input: a null or empty text has 0 tokens and is never drawn beyond its whole
copies; documents without a source count in the total only; a named source without documents falls
short by all of its budget. Null, negative and zero weights count as 0: such documents are not
drawn. Repeated texts are documents of their own. A very long text is tokenised whole and is one
document, the last document drawn may pass the budget by less than its own size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from tallyloom.functions.durable import durable
from tallyloom.operators.ranked import take_prefix, unit_hash

#: Folder of the tokenizers' vocabulary files and the file in use.
VOCABULARY = os.environ.get("TALLYLOOM_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenising pattern that belongs to byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces between the breaks of the pattern whose token counts a worker remembers.
REMEMBER = 500_000


class Counts(dict):
    """Token counts of the pieces of texts; a piece is encoded when it is first met."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.encode(piece))
        return n

    def of(self, text: str | None) -> int:
        """Tokens of a whole text: byte pairs are merged within the pieces of the pattern only."""
        if not text:
            return 0
        n = sum(map(self.__getitem__, self.split(text)))
        if len(self) > REMEMBER:
            self.clear()
        return n


def _counter(path: str):
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held["counts"] if "counts" in held else held.setdefault("counts", Counts(path))
        for b in batches:
            n = [counts.of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY, file: str = FILE) -> DataFrame:
    """doc_id, source and n_tokens of every document."""
    slim = documents.select("doc_id", "source", "text")
    return slim.mapInArrow(_counter(f"{vocabulary}/{file}"), "doc_id long, source string, n_tokens long")


def _weighted(sizes: DataFrame) -> DataFrame:
    w = F.lit(1.0)
    if "weight" in sizes.columns:
        given = F.nanvl(F.col("weight").cast("double"), F.lit(0.0))
        unit = F.pow(F.lit(10.0), F.floor(F.log10(given)) - 2)
        w = F.when(given > 0, F.round(given / unit) * unit).otherwise(F.lit(0.0))
    return sizes.select("doc_id", "source", "n_tokens", w.alias("weight"))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per (mix, source): its budget and copies per unit of weight."""
    kinds = durable(_weighted(sizes).groupBy("source", "weight").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")))  # by distinct weights
    per = kinds.groupBy("source").agg(F.sum("n").alias("source_tokens"), F.sum("docs").alias("source_docs"))
    total = per.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("total_tokens"))
    t = targets.join(per, "source", "left").join(F.broadcast(total))  # total: one row
    t = t.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("source_tokens", "source_docs")})
    t = t.withColumn("budget", F.col("target_share") * F.col("budget_fraction") * F.col("total_tokens"))
    # From the heaviest weight down: those before have all their copies, the rate serves the others.
    heavy = Window.partitionBy("mix_id", "source").orderBy(F.col("weight").desc())
    before = F.coalesce(F.sum("n").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("n") * F.col("weight")).over(heavy.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    steps = t.select("mix_id", "source", "budget", "max_repeats").join(kinds.filter("weight > 0"), "source")
    rate = F.when(after > 0, (F.col("budget") - F.col("max_repeats") * before) / after)
    steps = steps.withColumn("rate", rate).filter(F.col("rate") * F.col("weight") <= F.col("max_repeats"))
    rates = steps.groupBy("mix_id", "source").agg(F.max_by("rate", "weight").alias("rate"))
    # Without such a step even all copies of all documents do not exceed the budget.
    everything = F.when(F.col("source_docs") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return t.join(rates, ["mix_id", "source"], "left").withColumn("rate", F.greatest(F.coalesce("rate", everything), F.lit(0.0)))


def draw(sizes: DataFrame, planned: DataFrame, seed: int = 23) -> DataFrame:
    """The mixes' documents with the number of copies of each (1 to max_repeats)."""
    p = planned.select("mix_id", "source", "rate", F.col("max_repeats").cast("double").alias("most"))
    weighted = _weighted(sizes).filter(F.col("source").isNotNull() & (F.col("weight") > 0))
    rows = weighted.join(p, "source").withColumn("copies", F.least(F.col("rate") * F.col("weight"), "most"))
    rows = rows.withColumns({"whole": F.floor(F.col("copies") + 1e-12).cast("int"), "frac": F.greatest(F.col("copies") - F.floor(F.col("copies") + 1e-12), F.lit(0.0))})
    rest = rows.groupBy("mix_id", "source").agg(F.sum(F.col("frac") * F.col("n_tokens")).alias("__rest"))
    u = unit_hash(seed, "mix_id", "doc_id")
    able = (F.col("frac") > 1e-12) & (F.col("n_tokens") > 0)
    # q = random odds / inclusion odds; q / (1 + q) keeps its order and lies in [0, 1).
    q = (u / (1 - u)) / (F.col("frac") / (1 - F.col("frac")))
    rows = rows.withColumns({"__q": F.when(able, q / (1 + q)).otherwise(F.lit(1.0)), "__size": F.when(able, F.col("n_tokens")).otherwise(F.lit(0))})
    marked = take_prefix(rows, ["mix_id", "source"], "__q", "doc_id", rest, "__rest", size="__size", mark="more")
    return (
        marked.withColumn("n_copies", F.col("whole") + (F.col("more") & (F.col("__size") > 0)).cast("int"))
        .filter("n_copies > 0")
        .select("mix_id", "source", "doc_id", "n_tokens", "n_copies")
    )


def report(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """Actual against target shares of each (mix, source), and the sources that fall short."""
    got = drawn.groupBy("mix_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("n_copies")).alias("got_tokens"), F.count("*").alias("got_docs"),
        F.min("n_copies").alias("least_copies"), F.max("n_copies").alias("most_copies"),
    )
    got = got.withColumn("mix_tokens", F.sum("got_tokens").over(Window.partitionBy("mix_id")))  # one row a source
    none = F.lit(0).cast("long")
    out = planned.join(got, ["mix_id", "source"], "left").withColumns({c: F.coalesce(c, none) for c in ("got_tokens", "got_docs")})
    all_drawn = (F.col("got_docs") == F.col("source_docs")) & ((F.col("source_docs") == 0) | (F.col("least_copies") == F.col("max_repeats")))
    return out.select(
        "mix_id", "source", "target_share", "max_repeats", "budget", "source_tokens", "got_tokens", "got_docs", "most_copies",
        (all_drawn & (F.col("got_tokens") < F.col("budget"))).alias("short"),
        F.coalesce(F.try_divide("got_tokens", "mix_tokens"), F.lit(0.0)).alias("actual_share"),
    )
