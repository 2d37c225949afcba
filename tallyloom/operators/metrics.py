"""Binary metrics, threshold and scale searches as aggregates.

Rank metrics first group by score, so cumulative sums run over distinct scores and not over rows, and
over bins of scores before the scores of a bin. Sweeps over thresholds do not multiply the rows by the grid: labels are counted per whole
percent first, and the cumulative sums of at most 101 buckets a group give every threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.durable import durable
from tallyloom.functions.recode import clip, log_loss
from tallyloom.operators.ranked import cumulate


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Metrics of a confusion table; 0/0 is 0, specificity of an empty class is null."""
    precision, recall, spec = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp, None)
    pos, neg = tp + fn > 0, tn + fp > 0
    return {
        "accuracy": _ratio(tp + tn, tn + fp + fn + tp, None),
        # Only classes that occur are averaged.
        "balanced_accuracy": F.when(pos & neg, (recall + spec) / 2).when(pos, recall).when(neg, spec),
        "precision": precision,
        "recall": recall,
        "specificity": spec,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def _clean(df: DataFrame, y: str, p: str, w: str | None, by: Sequence[str], *extra: Column) -> DataFrame:
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    out = df.select(*by, *extra, F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"), weight.alias("w"))
    return out.filter(F.col("y").isin(0.0, 1.0) & F.col("p").isNotNull() & ~F.isnan("p") & (F.col("w") > 0))


def rank_metrics(df: DataFrame, y: str, p: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware ROC AUC and average precision per group; null with one class only."""
    # One row a distinct score, read four times below.
    g = durable(_clean(df, y, p, weight, by).groupBy(*by, "p").agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("neg")
    ))
    cum = cumulate(g, by, "p", ["pos", "neg"])
    totals = g.groupBy(*by).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
    cum = cum.join(totals, list(by)) if by else cum.join(F.broadcast(totals))  # one row
    tp, fp = F.col("pos_all") - F.col("pos_before"), F.col("neg_all") - F.col("neg_before")  # of scores at least this high
    s = cum.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("u"), F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp)).otherwise(0.0)).alias("a"),
        F.max("pos_all").alias("pos_all"), F.max("neg_all").alias("neg_all"),
    )
    both = (F.col("pos_all") > 0) & (F.col("neg_all") > 0)
    return s.select(*by, F.when(both, F.col("u") / (F.col("pos_all") * F.col("neg_all"))).alias("roc_auc"), F.when(both, F.col("a") / F.col("pos_all")).alias("average_precision"))


def binary_metrics(
    df: DataFrame, y: str, p: str, threshold: float | Column = 50.0, weight: str | None = None, by: Sequence[str] = (), percent: bool = True, eps: float = 1e-6
) -> DataFrame:
    """The metric bundle per group. Probabilities are in percent unless ``percent`` is false.

    Rows without a label, probability or positive weight take no part.
    """
    t = F.lit(float(threshold)) if not isinstance(threshold, Column) else threshold
    rows = _clean(df, y, p, weight, by, t.alias("t"))
    hit, one, w = F.col("p") >= F.col("t"), F.col("y") == 1, F.col("w")
    cell = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    p01 = clip(F.col("p") / (100 if percent else 1), eps, 1 - eps)
    a = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("t").alias("threshold"), F.sum("w").alias("weight_sum"),
        cell(~hit & ~one).alias("tn"), cell(hit & ~one).alias("fp"), cell(~hit & one).alias("fn"), cell(hit & one).alias("tp"),
        (F.sum(w * (p01 - F.col("y")) ** 2) / F.sum("w")).alias("brier"), (F.sum(w * log_loss(F.col("y"), p01, eps)) / F.sum("w")).alias("log_loss"),
        (F.sum(w * F.col("y")) / F.sum("w")).alias("actual_yes_rate"), (F.sum(w * hit.cast("double")) / F.sum("w")).alias("predicted_yes_rate"),
    )
    a = a.withColumns(rates(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))
    r = rank_metrics(df, y, p, weight, by)
    return a.join(r, list(by), "left") if by else a.join(F.broadcast(r))  # one row each


def sweep(df: DataFrame, y: str, p: str, low: int, high: int, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Metrics at every whole-percent threshold; p in percent, a row counts as yes if p >= t."""
    rows = _clean(df, y, p, weight, by)
    bucket = F.least(F.greatest(F.floor("p"), F.lit(low - 1)), F.lit(high)).cast("int")  # p >= t iff floor(p) >= t
    b = rows.groupBy(*by, bucket.alias("b")).agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("neg")
    )
    keys = list(by) or [F.lit(1)]
    totals = b.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = totals.withColumn("threshold", F.explode(F.sequence(F.lit(low), F.lit(high))))
    at = grid.join(b.withColumnRenamed("b", "threshold"), [*by, "threshold"], "left")
    w = Window.partitionBy(*keys).orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, fp = F.sum(F.coalesce("pos", F.lit(0.0))).over(w), F.sum(F.coalesce("neg", F.lit(0.0))).over(w)
    at = at.withColumns({"tp": tp, "fp": fp}).withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})
    return at.withColumns(rates(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))).drop("pos", "neg", "P", "N")


#: Grid and tie rule of each threshold search.
RULES = {"a": (1, 99), "b": (5, 95), "c": (5, 95)}


def best_threshold(df: DataFrame, y: str, p: str, rule: str = "a", metric: str = "balanced_accuracy", weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of the best metric.

    Rule a: values within numpy's isclose of the best are tied, nearest to 50 wins, then the lower
    one; fewer than 10 rows or one class give 50. Rules b and c: best value, then lowest threshold.
    """
    low, high = RULES[rule]
    s = sweep(df, y, p, low, high, weight, by)
    keys = list(by) or [F.lit(1)]
    top = F.max(metric).over(Window.partitionBy(*keys))
    if rule != "a":
        w = Window.partitionBy(*keys).orderBy(F.round(metric, 12).desc(), "threshold")
        return s.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(*by, "threshold", F.col(metric).alias("metric_value"))
    tied = s.withColumn("__top", top).filter(F.abs(F.col(metric) - F.col("__top")) <= 1e-8 + 1e-5 * F.abs("__top"))
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col("threshold") - 50), "threshold")
    chosen = tied.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(*by, "threshold", F.col(metric).alias("metric_value"))
    c = _clean(df, y, p, weight, by).groupBy(*by).agg(F.count("*").alias("n_rows"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    few = (F.col("n_rows") < 10) | (F.col("lo") == F.col("hi"))
    out = c.join(chosen, list(by), "left") if by else c.join(chosen, how="left")
    return out.select(*by, F.when(few, 50).otherwise(F.coalesce("threshold", F.lit(50))).alias("threshold"), F.when(~few, F.col("metric_value")).alias("metric_value"))


def scale_search(df: DataFrame, y: str, prior: str, correction: str, max_scale: float = 1.5, step: float = 0.05, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """alpha, log_loss, brier of p = clip(prior + alpha * correction), best first (ties: lower alpha).

    All scales are conditional sums in one pass over the rows; the grid is never crossed with them.
    """
    grid = [round(i * step, 10) for i in range(int(round(max_scale / step)) + 1)]
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(prior).cast("double").alias("p"), F.coalesce(F.col(correction).cast("double"), F.lit(0.0)).alias("c")).filter("y is not null and p is not null")
    at = lambda a: clip(F.col("p") + a * F.col("c"), lo, hi)
    s = rows.agg(*[F.avg(log_loss(F.col("y"), at(a))).alias(f"l{i}") for i, a in enumerate(grid)], *[F.avg((at(a) - F.col("y")) ** 2).alias(f"b{i}") for i, a in enumerate(grid)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"l{i}").alias("log_loss"), F.col(f"b{i}").alias("brier")) for i, a in enumerate(grid)])).alias("e")
    w = Window.orderBy(F.round("log_loss", 12), F.round("brier", 12), "alpha")  # one row a scale
    return s.select(each).select("e.*").withColumn("rank", F.row_number().over(w))


def ablation(
    calibration: DataFrame, test: DataFrame, y: str, predictions: Mapping[str, str], metric: str = "balanced_accuracy", rule: str = "b", weight: str | None = None
) -> DataFrame:
    """One row per ablation and weighting: its threshold from the calibration rows and the metrics of
    the test rows.

    ``predictions``: name of the ablation to its column of percent probabilities. Rows without a
    prediction take no part in that ablation only.
    """
    long = lambda df: df.select(y, *([weight] if weight else []), F.explode(F.array(*[F.struct(F.lit(n).alias("ablation"), F.col(c).cast("double").alias("p")) for n, c in predictions.items()])).alias("e")).select(y, *([weight] if weight else []), "e.*")
    best = durable(best_threshold(long(calibration), y, "p", rule, metric, by=["ablation"]).select("ablation", F.col("threshold").cast("double").alias("t")))
    rows = durable(long(test).join(F.broadcast(best), "ablation"))  # one row an ablation
    out = binary_metrics(rows, y, "p", F.col("t"), by=["ablation"]).withColumn("weighted", F.lit(False))
    if weight:
        out = out.unionByName(binary_metrics(rows, y, "p", F.col("t"), weight, by=["ablation"]).withColumn("weighted", F.lit(True)))
    return out
