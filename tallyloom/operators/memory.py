"""Error mining and rule memories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.durable import durable
from tallyloom.functions.recode import clip


def error_confidence(y: Column, p: Column) -> Column:
    """How sure a wrong percent probability was, 0 to 1."""
    return clip(F.when(y == 1, (50 - p) / 50).otherwise((p - 50) / 50), 0, 1)


def with_direction(df: DataFrame, y: str, p: str) -> DataFrame:
    up = F.col(y) == 1
    return df.withColumns(
        {
            "correction_direction": F.when(up, "increase").otherwise("decrease"),
            "error_type": F.when(up, "underprediction").otherwise("overprediction"),
            "error_confidence": error_confidence(F.col(y), F.col(p)),
        }
    )


def confident_errors(df: DataFrame, y: str, p: str, pattern: str, key: str, low: float = 30, high: float = 70, per_bucket: int = 6, total: int = 64) -> DataFrame:
    """Wrong and confident rows: the top of every (pattern, direction), then the top of all."""
    wrong = ((F.col(y) == 1) & (F.col(p) <= low)) | ((F.col(y) == 0) & (F.col(p) >= high))
    c = with_direction(df.filter(wrong), y, p)
    w = Window.partitionBy(pattern, "correction_direction").orderBy(F.col("error_confidence").desc(), key)
    top = c.withColumn("bucket_rank", F.row_number().over(w)).filter(F.col("bucket_rank") <= per_bucket)
    return top.orderBy(F.col("error_confidence").desc(), key).limit(total)


def wrong_rows(df: DataFrame, y: str, p: str, key: str, least: float = 0.2, total: int = 600) -> DataFrame:
    """Rows on the wrong side of 50 with enough confidence, most confident first."""
    wrong = ((F.col(y) == 1) & (F.col(p) < 50)) | ((F.col(y) == 0) & (F.col(p) >= 50))
    c = with_direction(df.filter(wrong), y, p).filter(F.col("error_confidence") >= least)
    return c.orderBy(F.col("error_confidence").desc(), key).limit(total)


def residual_candidates(df: DataFrame, residual: str, pattern: str, key: str, least: float = 0.40, total: int = 600) -> DataFrame:
    """Large residuals, spread over the strata direction x pattern, filled up by size.

    If no residual reaches ``least`` all rows are eligible.
    """
    work = df.filter(F.col(residual).isNotNull() & ~F.isnan(residual)).withColumn("abs_residual", F.abs(residual))
    work = work.withColumn("residual_direction", F.when(F.col(residual) >= 0, "increase").otherwise("decrease"))
    any_large = work.agg(F.max(F.col("abs_residual") >= least).alias("__any"))
    e = work.join(F.broadcast(any_large)).filter(~F.col("__any") | (F.col("abs_residual") >= least)).drop("__any")
    strata = e.select("residual_direction", pattern).distinct().agg(F.count("*").alias("__k"))
    w = Window.partitionBy("residual_direction", pattern).orderBy(F.col("abs_residual").desc(), key)
    quota = F.greatest(F.lit(1), F.ceil(total / F.greatest(F.col("__k"), F.lit(1))))
    e = e.withColumn("__r", F.row_number().over(w)).join(F.broadcast(strata)).withColumn("from_stratum", F.col("__r") <= quota)
    # Stratum picks come first; the rest fills up by size; the result is in order of size.
    return e.orderBy(F.col("from_stratum").desc(), F.col("abs_residual").desc(), key).limit(total).drop("__r", "__k")


def base_value(err: Column, specificity: Column, confidence: Column, estimated: Column) -> Column:
    return 0.35 * err + 0.25 * specificity + 0.20 * confidence + 0.20 * estimated


def _like(tokens: Column, other: list[str]) -> Column:
    """Jaccard similarity with a kept token set; two empty sets are alike."""
    if not other:
        return F.when(F.size(tokens) == 0, 1.0).otherwise(0.0)
    same = F.size(F.array_intersect(tokens, F.array(*map(F.lit, other))))
    return same / (F.size(tokens) + len(other) - same)


def distill(df: DataFrame, key: str, least_novelty: float = 0.25, per_bucket: int = 2, least_value: float = 0.55, total: int = 32) -> DataFrame:
    """Greedy novelty selection, best value first, at most ``total`` rules.

    ``df``: key, pattern, correction_direction, base_value, tokens. A rule is kept if it differs
    enough from the kept ones of its direction, its (pattern, direction) has room and its value
    0.85 base + 0.15 novelty is large enough. Any number of candidates: what was kept so far, at most
    ``total`` rules, goes into an expression, and an aggregate over all candidates behind the last
    kept one finds the next. Candidates refused once stay refused, as novelty and room only shrink.
    Null tokens are an empty set; candidates without a value take no part.
    """
    tokens = F.array_distinct(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    rows = durable(df.filter("base_value is not null and not isnan(base_value)").select(key, "pattern", "correction_direction", "base_value", tokens.alias("tokens")))
    kept: list[dict] = []
    while len(kept) < total:
        near = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(F.col("correction_direction").eqNullSafe(k["correction_direction"]), _like(F.col("tokens"), k["tokens"])).otherwise(0.0) for k in kept])
        used = sum((((F.col("pattern").eqNullSafe(k["pattern"])) & F.col("correction_direction").eqNullSafe(k["correction_direction"])).cast("int") for k in kept), F.lit(0))
        behind = F.lit(True)
        if kept:
            at = F.lit(kept[-1]["base_value"])
            behind = (F.col("base_value") < at) | ((F.col("base_value") == at) & (F.col(key) > kept[-1][key]))
        able = rows.filter(behind).withColumns({"novelty": 1 - near, "used": used}).withColumn("memory_value", 0.85 * F.col("base_value") + 0.15 * F.col("novelty"))
        able = able.filter((F.col("novelty") >= least_novelty) & (F.col("used") < per_bucket) & (F.col("memory_value") >= least_value))
        best = able.agg(F.min_by(F.struct(key, "pattern", "correction_direction", "novelty", "memory_value", "base_value", "tokens"), F.struct(-F.col("base_value"), F.col(key))).alias("b")).first()["b"]
        if best is None:
            break
        kept.append(best.asDict())
    out = [(k[key], k["pattern"], k["correction_direction"], float(k["novelty"]), float(k["memory_value"])) for k in kept]
    return df.sparkSession.createDataFrame(out, f"{key} long, pattern string, correction_direction string, novelty double, memory_value double")


#: Rules compared with the kept ones before they are compared with each other; sizes of a comparison.
STEP, SOME, KEPT = 4096, 32, 8192
#: Pairs whose token sets are compared at once.
PAIRS = 20_000


class _Sets:
    """Token sets as sorted codes, with two sketches of 64 bits.

    A bit of a sketch is the parity of the tokens of a share of the vocabulary, so two sketches differ in at
    most as many bits as the sets differ in tokens. No pair that is similar is lost by them.
    """

    def __init__(self, tokens: pa.Array, similar: float):
        words = tokens.flatten().dictionary_encode()
        codes = words.indices.fill_null(len(words.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.v = len(words.dictionary) + 1
        counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        cell = np.unique(np.repeat(np.arange(len(tokens)), counts) * self.v + codes)
        self.codes = cell % self.v
        self.size = np.bincount(cell // self.v, minlength=len(tokens))
        self.at = np.r_[0, np.cumsum(self.size)]
        # Tokens are dealt by frequency, then by chance.
        by_count = np.empty(self.v, np.int64)
        by_count[np.argsort(-np.bincount(self.codes, minlength=self.v), kind="stable")] = np.arange(self.v)
        self.sketches = []
        for place in (by_count, np.random.default_rng(7).permutation(self.v)):
            bits = np.uint64(1) << (place[self.codes] % 64).astype(np.uint64)
            sketch = np.zeros(len(tokens), np.uint64)
            full = np.flatnonzero(self.size)
            if len(full):
                sketch[full] = np.bitwise_xor.reduceat(bits, self.at[full])
            self.sketches.append(sketch)
        self.similar = similar
        #: By the sum of two sizes: most tokens in which similar sets differ.
        both = np.arange(2 * int(self.size.max(initial=0)) + 1)
        self.most = np.floor(both * (1 - similar) / (1 + similar) + 1e-9)

    def same(self, i: int) -> bytes:
        return self.codes[self.at[i] : self.at[i + 1]].tobytes()

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs are similar."""
        out = np.zeros(len(i), bool)
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], j[s : s + PAIRS]
            keys = []
            for side in (a, b):
                n = self.size[side]
                where = np.repeat(self.at[side] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                keys.append(np.repeat(np.arange(len(side)), n) * self.v + self.codes[where])
            keys = np.sort(np.concatenate(keys))
            common = np.bincount(keys[1:][keys[1:] == keys[:-1]] // self.v, minlength=len(a))
            out[s : s + PAIRS] = common / np.maximum(1, self.size[a] + self.size[b] - common) >= self.similar
        return out

    def candidates(self, rows: np.ndarray, kept: np.ndarray):
        """(row, kept) that may be similar, in pieces. ``kept`` must ascend by size."""
        kept_size, kept_sketch = self.size[kept], self.sketches[0][kept]
        for a in np.unique(self.size[rows]):
            own = rows[self.size[rows] == a]
            # Sizes between a * similar and a / similar, by the differences that are allowed.
            sizes = np.arange(len(self.most) // 2 + 1)
            near = sizes[np.abs(sizes - a) <= self.most[a + sizes]]
            first, last = np.searchsorted(kept_size, near[0]), np.searchsorted(kept_size, near[-1], "right")
            for s in range(first, last, KEPT):
                e = min(last, s + KEPT)
                most = np.minimum(self.most[a + kept_size[s:e]], 64).astype(np.uint8)
                for r in range(0, len(own), SOME):
                    part = own[r : r + SOME]
                    near_bits = np.bitwise_count(self.sketches[0][part][:, None] ^ kept_sketch[None, s:e]) <= most
                    hit = np.flatnonzero(near_bits)
                    if len(hit):
                        i, j = part[hit // (e - s)], kept[s + hit % (e - s)]
                        also = np.bitwise_count(self.sketches[1][i] ^ self.sketches[1][j]) <= most[hit % (e - s)]
                        yield i[also], j[also]


def _survivors(sets: _Sets) -> np.ndarray:
    """Numbers of the sets that stay; sets stand in their order of choice."""
    seen: set[bytes] = set()
    fresh, stay = [], np.zeros(len(sets.size), bool)
    for i in range(len(sets.size)):
        if not sets.size[i]:  # nothing in common with any other
            stay[i] = True
        elif (key := sets.same(i)) not in seen:  # an equal one goes the same way as the first
            seen.add(key)
            fresh.append(i)
    fresh, kept = np.array(fresh, np.int64), np.empty(0, np.int64)
    for s in range(0, len(fresh), STEP):
        rows = fresh[s : s + STEP]
        gone = np.zeros(len(sets.size), bool)
        for i, j in sets.candidates(rows, kept):
            open_ = ~gone[i]
            gone[i[open_][sets.alike(i[open_], j[open_])]] = True
        rows = rows[~gone[rows]]
        later: dict[int, list[np.ndarray]] = {}
        for i, j in sets.candidates(rows, rows[np.argsort(sets.size[rows], kind="stable")]):
            i, j = i[i < j], j[i < j]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for a, b in zip(*np.unique(i, return_index=True)):
                later.setdefault(int(a), []).append(j[b : np.searchsorted(i, a, "right")])
        for a in sorted(later):
            if not gone[a]:
                j = np.concatenate(later[a])
                j = j[~gone[j]]
                gone[j[sets.alike(np.full(len(j), a), j)]] = True
        kept = np.concatenate([kept, rows[~gone[rows]]])
        kept = kept[np.argsort(sets.size[kept], kind="stable")]
    stay[kept] = True
    return np.flatnonzero(stay)


def greedy_unique(df: DataFrame, key: str, groups: list[str], value: str, similar: float) -> DataFrame:
    """Keys that survive greedy de-duplication by token sets within the groups, best value first.

    A candidate is dropped if a kept one of its group is at least ``similar``. Candidates are compared
    with the kept ones of a possible size by sketches of 64 bits, and by their tokens only if the sketches
    allow it; one group is one task, which holds its tokens as Arrow columns. The comparisons grow with
    the square of the kept rules of a group.
    """

    def run(rows: pa.Table) -> pa.Table:
        keys = rows.column(key).to_numpy()
        order = np.lexsort((keys, -rows.column(value).cast(pa.float64()).to_numpy().astype(np.float64)))
        tokens = rows.column("tokens").take(pa.array(order)).combine_chunks()
        tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
        return pa.table({key: pa.array(keys[order][_survivors(_Sets(tokens, similar))], pa.int64())})

    return df.select(key, "tokens", value, *groups).groupBy(*groups).applyInArrow(run, f"{key} long")
