"""Features and similarity retrieval.

The sources (memories, demonstrations) are a small table by construction: a memory has at most a
few hundred rules. Queries are all rows. The sources are sent to the executors in blocks of
``BLOCK`` rows and compared with Arrow batches of queries by matrix products of at most ``CELLS``
cells; a pass over the queries takes as many blocks as ``PASS_BYTES`` hold and returns only the best
k, so nothing of the size queries x sources is ever shuffled or held. Larger source tables take the
same path in more passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.recode import clip, log_loss

BLOCK = 20_000
#: Similarities that a task holds at once.
CELLS = 1_000_000
#: Candidates whose exact similarities a task computes at once.
PIECE = 100_000
#: Bytes of sources that are broadcast for a pass over the queries.
PASS_BYTES = 64_000_000


def fit_features(df: DataFrame, fit: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Add ``x``: median-imputed, standardised (population sd) numbers and one-hot categories.

    Statistics come from ``fit``. Every code of a category gets a column (codes are few by nature: they
    are the answers of a question); codes not seen in ``fit`` give zeros. Missing categories take the most frequent code (ties: the smallest).
    """
    s = fit.agg(*[F.median(F.col(c).cast("double")).alias(f"m_{c}") for c in numbers]).first() if numbers else {}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(s[f"m_{c}"] or 0.0))) for c in numbers}
    t = fit.agg(*[F.avg(filled[c]).alias(f"a_{c}") for c in numbers], *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in numbers]).first() if numbers else {}
    parts: list[Column] = [(filled[c] - float(t[f"a_{c}"] or 0.0)) / float(t[f"s_{c}"] or 1.0) for c in numbers]
    for c in categories:
        seen = [r[0] for r in fit.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), c).collect()]
        value = F.coalesce(F.col(c), F.lit(seen[0])) if seen else F.col(c)
        parts += [F.when(value == v, 1.0).otherwise(0.0) for v in sorted(seen)]
    return df.withColumn("x", F.array(*parts))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero norm gives 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _units(rows) -> np.ndarray:
    x = np.asarray(np.stack(list(rows)), dtype=np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _likely(a: np.ndarray, k: int, least: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells that may be among the k best of their row, and lower bounds of the k-th best values.

    ``least``: lower bounds known before. The k-th largest of the maxima of disjoint groups of cells is
    a lower bound of the k-th largest cell.
    """
    n = a.shape[1]
    m = n // 64
    if m >= 2 * k:
        least = np.maximum(least, -np.partition(-a[:, : 64 * m].reshape(len(a), 64, m).max(1), k - 1, axis=1)[:, k - 1])
    elif n > k:
        least = np.maximum(least, -np.partition(-a, k - 1, axis=1)[:, k - 1])
    i, j = np.divmod(np.flatnonzero(a >= (least - 2 * slack).astype(np.float32)[:, None]), n)
    return i, j, least


def _best(k: int, i: np.ndarray, g: np.ndarray, own: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best cells of each row i and group g, and their ranks; ties: the smaller id."""
    order = np.lexsort((own, -value, g, i))
    i, g, own, value = i[order], g[order], own[order], value[order]
    at = np.arange(len(i))
    first = (at == 0) | (i != np.roll(i, 1)) | (g != np.roll(g, 1))
    rank = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    top = rank <= k
    return i[top], g[top], own[top], value[top], rank[top]


def _score_udf(held, spaces: Sequence[tuple[str, float, bool]], same: float, k: int, least: float, by: str | None, drop_self: bool, decimals: int):
    """The k best sources of all blocks, of each row: likely ones by single precision, then exact values."""
    low = 0.0 if same else -1.0
    factor = [w / 2 if shifted else w for _, w, shifted in spaces]
    shift = sum((w / 2 for _, w, shifted in spaces if shifted), 0.0)

    def scores(b: dict, i: np.ndarray, src: dict, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for s in range(0, len(i), PIECE):
            e, f = i[s : s + PIECE], j[s : s + PIECE]
            sim = np.full(len(e), shift)
            for (name, _, _), w in zip(spaces, factor):
                sim += w * np.einsum("ij,ij->i", b[name][e], src[name][f])
            if same:
                sim += same * (b["code"][e] == src["code"][f])
            out[s : s + PIECE] = np.round(np.clip(sim, low, 1.0), decimals)
        return out

    def some(b: dict) -> pd.DataFrame:
        ids, found, bounds = b["id"], [], {}
        width = sum(b[name].shape[1] for name, _, _ in spaces)
        # Single precision is off by at most this; decimals are cut too.
        slack = (width + 16) * 1.2e-7 * (sum(map(abs, factor)) + abs(shift) + abs(same)) + 10.0**-decimals
        for src in held.value["blocks"]:
            approx = np.concatenate([w * b[name] for (name, _, _), w in zip(spaces, factor)], axis=1).astype(np.float32) @ src["all"].T
            approx += np.float32(shift)
            if same:
                for c in np.unique(b["code"]):
                    if c >= 0:
                        approx[np.ix_(b["code"] == c, src["code"] == c)] += np.float32(same)
            np.clip(approx, low, 1.0, out=approx)
            if drop_self:
                approx[ids[:, None] == src["id"][None, :]] = -np.inf
            for g, cols in src["groups"]:
                part = approx if cols is None else approx[:, cols]
                i, j, bounds[g] = _likely(part, k, bounds.get(g, np.full(len(ids), least)), slack)
                j = j if cols is None else cols[j]
                value = scores(b, i, src, j)
                own = src["id"][j]
                keep = value >= least
                if drop_self:
                    keep &= own != ids[i]
                found.append(_best(k, i[keep], np.full(int(keep.sum()), g), own[keep], value[keep])[:4])
        i, _, own, value, rank = _best(k, *(np.concatenate(c) for c in zip(*found)))
        return pd.DataFrame({"id": ids[i], "source_id": own, "similarity": value, "rank": rank.astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, CELLS // max(len(src["id"]) for src in held.value["blocks"]))
        for b in batches:
            for s in range(0, len(b), rows):
                part = b.iloc[s : s + rows]
                piece = {"id": part["id"].to_numpy(), **{n: _units(part[n]) for n, _, _ in spaces}}
                if same:
                    piece["code"] = part["pattern"].map(held.value["codes"]).fillna(-1).to_numpy(dtype=np.int64)
                yield some(piece)

    return run


def top_similar(
    queries: DataFrame, sources: DataFrame, spaces: Sequence[tuple[str, float, bool]], k: int, least: float = -1.0, same_pattern: float = 0.0,
    by: str | None = None, drop_self: bool = True, decimals: int = 9,
) -> DataFrame:
    """id, source_id, similarity, rank of the k most similar sources of every query.

    ``spaces``: (array column, weight, shift cosine to 0..1). ``same_pattern``: weight of equal
    ``pattern``. ``by``: column of the sources; k per value of it. Ties: the smaller source id.
    Rows whose arrays are null take no part.
    """
    spark = queries.sparkSession
    names = [s[0] for s in spaces]
    extra = (["pattern"] if same_pattern else []) + ([by] if by else [])
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    src = sources.filter(whole).select("id", *names, *dict.fromkeys(extra))
    n, width = src.agg(F.count("*"), sum((F.coalesce(F.max(F.size(c)), F.lit(0)) for c in names), F.lit(0))).first()
    n_blocks = max(1, -(-n // BLOCK))
    blocks_a_pass = max(1, PASS_BYTES // (12 * BLOCK * max(1, width)))
    q = queries.filter(whole).select("id", *names, *(["pattern"] if same_pattern else []))
    found = []
    for first in range(0, n_blocks, blocks_a_pass):
        blocks, codes, groups = [], {}, {}
        for i in range(first, min(n_blocks, first + blocks_a_pass)):
            part = src.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i).toPandas()
            if not len(part):
                continue
            block = {"id": part["id"].to_numpy(), **{c: _units(part[c]) for c in names}}
            block["all"] = np.concatenate([block[c] for c in names], axis=1).astype(np.float32)
            if same_pattern:  # a null pattern equals no other
                block["code"] = np.array([-2 if pd.isna(p) else codes.setdefault(p, len(codes)) for p in part["pattern"]])
            block["groups"] = [(0, None)] if by is None else [(groups.setdefault(g, len(groups)), np.flatnonzero(part[by] == g)) for g in np.unique(part[by])]
            blocks.append(block)
        if blocks:
            run = _score_udf(spark.sparkContext.broadcast({"blocks": blocks, "codes": codes}), spaces, same_pattern, k, least, by, drop_self, decimals)
            found.append(q.mapInPandas(run, "id long, source_id long, similarity double, rank int"))
    if not found:
        return spark.createDataFrame([], "id long, source_id long, similarity double, rank int")
    out = reduce(DataFrame.unionByName, found)
    if by:
        out = out.join(F.broadcast(sources.select(F.col("id").alias("source_id"), by)) if n_blocks == 1 else sources.select(F.col("id").alias("source_id"), by), "source_id")
    if len(found) == 1:  # ranks are those of all sources
        return out
    w = Window.partitionBy("id", *([by] if by else [])).orderBy(F.col("similarity").desc(), "source_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def diverse(scored: DataFrame, score: str, k: int, direction: str = "correction_direction", tie: str = "source_id") -> DataFrame:
    """First the best of every direction, then the others, k a query; adds ``pick`` 1..k."""
    own = Window.partitionBy("id", direction).orderBy(F.col(score).desc(), tie)
    all_ = Window.partitionBy("id").orderBy((F.col("__d") > 1).cast("int"), F.col(score).desc(), tie)
    return scored.withColumn("__d", F.row_number().over(own)).withColumn("pick", F.row_number().over(all_)).filter(F.col("pick") <= k).drop("__d")


def ranked(scored: DataFrame, score: str, k: int, *ties: Column | str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.col(score).desc(), *ties)
    return scored.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k)


def retrieve_v4(similar: DataFrame, memories: DataFrame, k: int = 2, least: float = 0.45) -> DataFrame:
    """Similarity at least ``least``; by similarity, then memory value."""
    s = similar.filter(F.col("similarity") >= least).join(memories.select(F.col("id").alias("source_id"), "memory_value"), "source_id")
    return ranked(s, "similarity", k, F.col("memory_value").desc(), "source_id")


def retrieve_v5(similar: DataFrame, memories: DataFrame, k: int = 3, least: float = 0.45) -> DataFrame:
    """0.70 similarity + 0.30 value, best of each direction first."""
    s = similar.filter(F.col("similarity") >= least).join(memories.select(F.col("id").alias("source_id"), "memory_value", "correction_direction"), "source_id")
    return diverse(s.withColumn("score", 0.70 * F.col("similarity") + 0.30 * F.coalesce("memory_value", F.lit(0.0))), "score", k)


def retrieve_valued(similar: DataFrame, memories: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.45, least_q: float = -0.002, tau: float = 0.02) -> DataFrame:
    """0.60 similarity + 0.20 (0.5 + 0.5 tanh(q / tau)) + 0.10 prior value + 0.10 same pattern."""
    m = memories.select(F.col("id").alias("source_id"), "q_value", "memory_value", "correction_direction", F.col("pattern").alias("m_pattern"))
    s = similar.filter(F.col("similarity") >= least).join(m.filter(F.col("q_value") >= least_q), "source_id").join(queries.select("id", "pattern"), "id")
    score = (
        0.60 * F.col("similarity") + 0.20 * (0.5 + 0.5 * F.tanh(F.col("q_value") / max(1e-6, tau))) + 0.10 * F.coalesce("memory_value", F.lit(0.0))
        + 0.10 * (F.col("pattern") == F.col("m_pattern")).cast("double")
    )
    return diverse(s.withColumn("score", score), "score", k)


def retrieve_residual(similar: DataFrame, memories: DataFrame, k: int = 5, least: float = 0.42) -> DataFrame:
    """0.85 similarity + 0.15 min(1, strength)."""
    s = similar.filter(F.col("similarity") >= least).join(memories.select(F.col("id").alias("source_id"), "memory_strength"), "source_id")
    score = 0.85 * F.col("similarity") + 0.15 * F.least(F.lit(1.0), F.coalesce("memory_strength", F.lit(0.0)))
    return ranked(s.withColumn("score", score), "score", k, "source_id")


def value_memories(neighbours: DataFrame, memories: DataFrame, outcomes: DataFrame, step: float = 10.0, kappa: float = 20.0) -> DataFrame:
    """Counterfactual value of each memory over its neighbours.

    ``neighbours``: id (memory), source_id (training row), similarity. p0 is moved by step times
    similarity in the memory's direction; the reward is the drop in log loss, weighted by
    similarity squared and shrunk by n / (n + kappa).
    """
    d = F.when(F.col("correction_direction") == "increase", 1.0).otherwise(-1.0)
    j = neighbours.join(memories.select("id", "correction_direction"), "id").join(outcomes.select(F.col("id").alias("source_id"), "y", "p"), "source_id")
    y, p0 = F.col("y").cast("double"), F.col("p")
    p1 = clip(p0 + d * step * F.col("similarity"), 0, 100)
    j = j.withColumns({"r": log_loss(y, p0 / 100) - log_loss(y, p1 / 100), "w": F.col("similarity") ** 2})
    n = F.count("*")
    mean = F.sum(F.col("r") * F.col("w")) / F.sum("w")
    a = j.groupBy("id").agg(
        n.alias("support_n"), mean.alias("reward_mean"), (n / (n + kappa) * mean).alias("q_value"),
        F.avg((F.col("r") > 0).cast("double")).alias("positive_rate"), F.avg((F.col("r") < 0).cast("double")).alias("harmful_rate"),
    )
    return memories.select("id").join(a, "id", "left").fillna(0, ["support_n", "reward_mean", "q_value", "positive_rate", "harmful_rate"])


#: Factor of a correction's stated strength.
FACTORS = {"weak": 0.60, "moderate": 1.0, "strong": 1.25}


def empirical_correction(selected: DataFrame, strength: Column | None = None, kappa: float = 2.0, most: float = 0.25) -> DataFrame:
    """id, correction: residuals weighted by similarity squared times confidence, shrunk, limited.

    ``selected``: id, similarity, confidence, residual. Without a strength no factor is applied.
    """
    w = F.greatest(F.col("similarity"), F.lit(0.0)) ** 2 * F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.05))
    n = F.count("*")
    a = selected.groupBy("id").agg(F.try_divide(F.sum(w * F.col("residual")), F.sum(w)).alias("m"), n.alias("n"), *([F.first(strength).alias("s")] if strength is not None else []))
    factor = F.lit(1.0)
    if strength is not None:
        factor = F.lit(0.0)
        for k, v in FACTORS.items():
            factor = F.when(F.col("s") == k, v).otherwise(factor)
    return a.select("id", clip(F.coalesce("m", F.lit(0.0)) * F.col("n") / (F.col("n") + kappa) * factor, -most, most).alias("correction"))
