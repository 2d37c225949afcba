"""Eight-way patterns: thresholds, labels, smoothed base rates and anchors.

Fitted state is an aggregate of the memory split: one row of thresholds, nine rows of rates. It is
broadcast, which is safe because its size is fixed by the eight patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranked import quantiles

#: Pattern order 1 to 8, from most to least favourable.
ORDER = [
    f"{m} Motivation / {c} Capability / {a} Cue" for m in ("High", "Low") for c in ("High", "Low") for a in ("Strong", "Weak")
]
OVERALL = "__overall__"
SCORES = ("motivation_score", "capability_score", "activation_score")


def fit_thresholds(memory: DataFrame, mode: str = "median", fixed: float = 2.5) -> DataFrame:
    """One row t_motivation, t_capability, t_activation: exact medians or a fixed value."""
    names = [f"t_{c.removesuffix('_score')}" for c in SCORES]
    if mode == "fixed":
        return memory.sparkSession.range(1).select(*[F.lit(float(fixed)).alias(n) for n in names])
    long = memory.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("x")) for c, n in zip(SCORES, names)])).alias("e")).select("e.*")
    medians = quantiles(long, ["name"], "x", {"m": 0.5})  # one row a score
    return medians.agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("m"))), F.lit(float(fixed))).alias(n) for n in names])


def label(m: Column, c: Column, a: Column, tm: Column, tc: Column, ta: Column) -> Column:
    """A missing score counts as Low or Weak."""
    return F.concat_ws(
        " / ",
        F.when(m >= tm, "High Motivation").otherwise("Low Motivation"),
        F.when(c >= tc, "High Capability").otherwise("Low Capability"),
        F.when(a >= ta, "Strong Cue").otherwise("Weak Cue"),
    )


def assign(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add hbm8_pattern and its order 1 to 8."""
    out = df.join(F.broadcast(thresholds))  # one row
    out = out.withColumn("hbm8_pattern", label(*[F.col(c) for c in SCORES], F.col("t_motivation"), F.col("t_capability"), F.col("t_activation")))
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("hbm8_pattern")).cast("int")
    return out.withColumn("hbm8_theory_order", order).drop(*thresholds.columns)


def base_rates(memory: DataFrame, prior_strength: float = 10.0, y: str = "vaccinated", pattern: str = "hbm8_pattern") -> DataFrame:
    """pattern, n, yes, raw_rate, smoothed_rate: all eight patterns and the overall row.

    (yes + k * overall) / (n + k); a pattern without rows has the overall rate.
    """
    spark = memory.sparkSession
    known = memory.filter(F.col(y).isNotNull())
    names = spark.createDataFrame([(p,) for p in ORDER], "pattern string")
    per = known.groupBy(F.col(pattern).alias("pattern")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("yes"))
    total = known.agg(F.count("*").alias("all_n"), F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("all_yes"))
    overall = F.coalesce(F.try_divide(F.col("all_yes"), F.col("all_n")), F.lit(0.5))
    rows = names.join(per, "pattern", "left").join(F.broadcast(total)).select(
        "pattern", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("yes", F.lit(0.0)).alias("yes"), overall.alias("o")
    )
    k = F.lit(float(prior_strength))
    rows = rows.select(
        "pattern", "n", "yes", F.when(F.col("n") > 0, F.col("yes") / F.col("n")).otherwise(F.col("o")).alias("raw_rate"),
        F.when(F.col("n") > 0, (F.col("yes") + k * F.col("o")) / (F.col("n") + k)).otherwise(F.col("o")).alias("smoothed_rate"),
    )
    last = total.select(F.lit(OVERALL).alias("pattern"), F.col("all_n").alias("n"), F.col("all_yes").alias("yes"), overall.alias("raw_rate"), overall.alias("smoothed_rate"))
    return rows.unionByName(last)


def _wide_overall(rates: DataFrame) -> DataFrame:
    return rates.filter(F.col("pattern") == OVERALL).select(F.col("n").alias("all_n"), F.col("yes").alias("all_yes"), F.col("raw_rate").alias("all_rate"), F.col("smoothed_rate").alias("all_smoothed"))


def anchor(df: DataFrame, rates: DataFrame, leave_one_out: bool = False, prior_strength: float = 10.0, y: str = "vaccinated") -> DataFrame:
    """Add anchor_probability (0 to 100) and anchor_n; an unknown pattern gets the overall rate.

    ``leave_one_out`` takes the row's own label out of its pattern and of the total; with at most
    one row left the overall raw rate is used.
    """
    per = rates.filter(F.col("pattern") != OVERALL).select(
        F.col("pattern").alias("hbm8_pattern"), F.col("n").alias("__n"), F.col("yes").alias("__yes"), F.col("smoothed_rate").alias("__s")
    )
    out = df.join(F.broadcast(per), "hbm8_pattern", "left").join(F.broadcast(_wide_overall(rates)))
    n, yes = F.coalesce("__n", F.col("all_n")), F.coalesce("__yes", F.col("all_yes"))
    if leave_one_out:
        own, k = F.col(y).cast("double"), F.lit(float(prior_strength))
        rest = F.try_divide(F.col("all_yes") - own, F.col("all_n") - 1)
        p = F.when((n <= 1) | (F.col("all_n") <= 1), F.col("all_rate")).otherwise((yes - own + k * rest) / (n - 1 + k))
        count = F.greatest(n - 1, F.lit(0))
    else:
        p, count = F.coalesce("__s", F.col("all_smoothed")), n
    return out.withColumns({"anchor_probability": 100 * p, "anchor_n": count}).drop("__n", "__yes", "__s", "all_n", "all_yes", "all_rate", "all_smoothed")
