"""Summaries: patterns, score bands, construct descriptions, call diagnostics, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.durable import durable
from tallyloom.functions.recode import band_label
from tallyloom.operators.ranked import cumulate, quantiles


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean over rows with a finite positive weight; null if there are none."""
    ok = (w > 0) & ~F.isnan(w) & (w < float("inf")) & x.isNotNull()
    return F.try_divide(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)))


def pattern_summary(df: DataFrame, pattern: str, means: Sequence[str], y: str = "vaccinated", weight: str = "survey_weight") -> DataFrame:
    """Per pattern (null is a group): n, yes, no, rates, means, descending competition ranks."""
    a = df.groupBy(pattern).agg(
        F.count(y).alias("n"), F.sum(y).alias("yes"), (F.count(y) - F.sum(y)).alias("no"), F.avg(y).alias("rate"),
        weighted_mean(F.col(y), F.col(weight)).alias("weighted_rate"), *[F.avg(m).alias(f"mean_{m}") for m in means],
    )
    w = lambda c: F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.col(c).desc_nulls_last()))
    return a.withColumns({"rank_rate": w("rate"), "rank_weighted_rate": w("weighted_rate")})


def band_summary(df: DataFrame, scores: Sequence[str], edges: Sequence[int] = (1, 2, 3, 4), y: str = "vaccinated", weight: str = "survey_weight") -> DataFrame:
    """Per score and observed band: n, rate, weighted rate. One pass over the rows."""
    long = df.select(y, weight, F.explode(F.array(*[F.struct(F.lit(s).alias("score"), band_label(F.col(s), edges).alias("band")) for s in scores])).alias("e"))
    return long.select(y, weight, "e.*").filter("band is not null").groupBy("score", "band").agg(
        F.count(y).alias("n"), F.avg(y).alias("rate"), weighted_mean(F.col(y), F.col(weight)).alias("weighted_rate")
    )


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the average rank of a value within its group (ties share the mean rank).

    Ranks come from counts per distinct value, summed over bins of values first.
    """
    c = cumulate(durable(df.groupBy(*by, value).agg(F.count("*").alias("__n"))), by, value, ["__n"])
    c = c.withColumn(out, F.col("__n_before") + (F.col("__n") + 1) / 2).drop("__n", "__n_before")
    return df.join(c, [*by, value])


def describe(df: DataFrame, scores: Sequence[str], y: str = "vaccinated", weight: str = "survey_weight") -> DataFrame:
    """Per score: counts, missing rate, moments, exact quartiles, Pearson and Spearman with y."""
    s = [F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("x")) for c in scores]
    long = df.select(F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), F.explode(F.array(*s)).alias("e")).select("y", "w", "e.*")
    a = long.groupBy("score").agg(
        F.count("x").alias("n"), (1 - F.count("x") / F.count("*")).alias("missing_rate"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        F.corr("x", "y").alias("pearson"), weighted_mean(F.col("x"), F.col("w")).alias("weighted_mean"),
    )
    pairs = long.filter("x is not null and y is not null").select("score", "x", "y")
    ranks = average_rank(average_rank(pairs, ["score"], "x", "rx"), ["score"], "y", "ry")
    quarters = quantiles(long, ["score"], "x", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return a.join(quarters, "score", "left").join(ranks.groupBy("score").agg(F.corr("rx", "ry").alias("spearman")), "score", "left")


def phase_diagnostics(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group of a call log: ok, errors, success rate, attempts, token sums."""
    u = lambda f: F.sum(F.coalesce(F.col(f"usage.{f}"), F.lit(0))).alias(f)
    ok = F.col("status") == "ok"
    return log.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), F.avg(ok.cast("double")).alias("success_rate"),
        F.sum(F.coalesce("attempt_count", F.lit(1))).alias("attempts"), u("input_tokens"), u("output_tokens"), u("total_tokens"),
    )


def histogram(log: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Counts and shares of the values of a column per group; null is left out."""
    c = log.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(list(by) or [F.lit(1)]))))


def require_success(log: DataFrame, expected: int, least: float = 0.995) -> None:
    """Raise if fewer than ``least`` of the expected rows are ok."""
    ok = log.filter("status = 'ok'").count()
    if expected and ok / expected < least:
        raise RuntimeError(f"only {ok} of {expected} rows are ok, {least:.1%} are required")


def repair_weights(df: DataFrame, weight: str, out: str = "fit_weight", normalise: bool = True) -> DataFrame:
    """Replace bad weights by the median of the good ones and scale to mean 1."""
    w = F.col(weight).cast("double")
    good = F.when((w > 0) & ~F.isnan(w) & (w < float("inf")), w)
    m = quantiles(df.select(good.alias("__w")), [], "__w", {"__m": 0.5}).select(F.coalesce("__m", F.lit(1.0)).alias("__m"))
    fixed = df.join(F.broadcast(m)).withColumn(out, F.coalesce(good, F.col("__m"))).drop("__m")
    if not normalise:
        return fixed
    mean = fixed.agg(F.avg(out).alias("__a"))
    return fixed.join(F.broadcast(mean)).withColumn(out, F.col(out) / F.col("__a")).drop("__a")


def error_profile(df: DataFrame, by: str, y: str, p: str, values: Sequence[str]) -> DataFrame:
    """Per group: rate, mean p, mean error, shares of false positives and negatives, means of values among them."""
    fp, fn = (F.col(y) == 0) & (F.col(p) >= 50), (F.col(y) == 1) & (F.col(p) < 50)
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(y).alias("rate"), F.avg(F.col(p) / 100).alias("mean_p"), F.avg(F.col(y) - F.col(p) / 100).alias("mean_error"),
        F.avg(fp.cast("double")).alias("fp_share"), F.avg(fn.cast("double")).alias("fn_share"),
        *[F.avg(v).alias(f"{v}_all") for v in values], *[F.avg(F.when(fp, F.col(v))).alias(f"{v}_fp") for v in values], *[F.avg(F.when(fn, F.col(v))).alias(f"{v}_fn") for v in values],
    )


def union_aligned(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Union of tables with different columns, in a fixed order; absent columns are null."""
    out = None
    for f in frames:
        g = f.select(*[F.col(c) if c in f.columns else F.lit(None).cast("string").alias(c) for c in columns])
        out = g if out is None else out.unionByName(g)
    return out


def pivot_metrics(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric by index and the given values of a column."""
    return df.groupBy(*index).pivot(column, list(values)).agg(*[F.avg(m).alias(m) for m in metrics])
