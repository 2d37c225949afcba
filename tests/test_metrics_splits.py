import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import metrics, patterns, splits, stats


def pairs(spark, y, p, w=None):
    w = [1.0] * len(y) if w is None else w
    return spark.createDataFrame([(int(a), float(b), float(c), i) for i, (a, b, c) in enumerate(zip(y, p, w))], "y int, p double, w double, i long")


def auc(y, p, w):
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    s = sum(w[i] * w[j] * ((p[i] > p[j]) + 0.5 * (p[i] == p[j])) for i in pos for j in neg)
    return s / (w[pos].sum() * w[neg].sum())


def test_rank_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y, p, w = rng.integers(0, 2, 200), np.round(rng.random(200) * 20) * 5, rng.random(200) + 0.1
    got = metrics.rank_metrics(pairs(spark, y, p, w), "y", "p", "w").first()
    assert got.roc_auc == pytest.approx(auc(y, p, w))
    ap = 0.0
    for t in sorted(set(p), reverse=True):
        at = p == t
        ap += w[at & (y == 1)].sum() * w[(p >= t) & (y == 1)].sum() / w[p >= t].sum()
    assert got.average_precision == pytest.approx(ap / w[y == 1].sum())
    rev = metrics.rank_metrics(pairs(spark, y, 100 - p, w), "y", "p", "w").first()
    assert rev.roc_auc == pytest.approx(1 - got.roc_auc)


def test_bundle_edges(spark):
    one = metrics.binary_metrics(pairs(spark, [1, 1], [80, 20]), "y", "p").first()
    assert one.roc_auc is None and one.specificity is None and one.balanced_accuracy == 0.5
    junk = spark.createDataFrame([(1, float("nan"), 1.0), (None, 50.0, 1.0), (0, 10.0, -1.0), (1, 90.0, 2.0), (0, 10.0, 1.0)], "y int, p double, w double")
    got = metrics.binary_metrics(junk, "y", "p", weight="w").first()
    assert (got.n, got.tp, got.tn, got.accuracy) == (2, 2.0, 1.0, 1.0)
    assert metrics.binary_metrics(junk.filter("false"), "y", "p").first().n == 0


def test_threshold_ties(spark):
    df = pairs(spark, [0, 1] * 10, [20, 80] * 10)
    pick = lambda r: metrics.best_threshold(df, "y", "p", r, "accuracy").first().threshold
    assert (pick("a"), pick("b"), pick("c")) == (50, 21, 21)
    assert metrics.best_threshold(pairs(spark, [0, 1], [20, 80]), "y", "p", "a").first().threshold == 50
    s = metrics.sweep(df, "y", "p", 1, 99).orderBy("threshold").collect()
    assert all(a.recall >= b.recall for a, b in zip(s, s[1:]))


def test_sweep_equals_direct_counts(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), rng.random(300) * 120 - 10
    df = pairs(spark, y, p)
    for r in metrics.sweep(df, "y", "p", 5, 95).collect():
        hit = p >= r.threshold
        assert (r.tp, r.fp) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())


def test_scale_search_prefers_zero_without_signal(spark):
    df = spark.createDataFrame([(1, 0.9, -0.5), (0, 0.1, 0.5)] * 5, "y int, p double, c double")
    assert metrics.scale_search(df, "y", "p", "c").filter("rank = 1").first().alpha == 0.0


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("s"))
    runs = [sorted((r.id, r.split) for r in splits.three_way(df.repartition(n), ["s"], "id").collect()) for n in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2]
    counts = {r.split: r["count"] for r in splits.three_way(df, ["s"], "id").groupBy("split").count().collect()}
    assert counts["memory"] == pytest.approx(800, abs=3) and counts["calibration"] == pytest.approx(400, abs=3)


def test_folds_and_hot_stratum(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("s"))
    f = splits.folds(df, ["s"], "id", 5).groupBy("s", "fold").count().groupBy("s").agg((F.max("count") - F.min("count")).alias("d"))
    assert f.agg(F.max("d")).first()[0] <= 1
    ranks = splits.dense_order(df, ["s"], "id").groupBy("s").agg(F.countDistinct("rank0").alias("a"), F.count("*").alias("b"), F.max("rank0").alias("m"))
    assert ranks.filter("a <> b or m <> b - 1").count() == 0


def test_null_stratum_and_empty(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id long, s string")
    assert splits.three_way(df, ["s"], "id").count() == 20
    assert splits.three_way(df.filter("false"), ["s"], "id").count() == 0


def test_allocation_sums_to_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert sorted(r.quota for r in splits.allocate(df, "w", 10, ["k"]).collect()) == [3, 3, 4]


def test_reference_split(spark):
    ids = spark.range(5).select(F.col("id").alias("source_row_index"))
    ok = spark.createDataFrame([(1, "Memory"), (2, "TEST")], "source_index long, phase string")
    assert {tuple(r) for r in splits.check_reference_split(ok, ids).collect()} == {(1, "memory"), (2, "test")}
    bad = ok.unionByName(spark.createDataFrame([(9, "test")], "source_index long, phase string"))
    with pytest.raises(ValueError):
        splits.check_reference_split(bad, ids)
    assert splits.check_reference_split(bad, ids, strict=False).count() == 2


def test_base_rates_and_loo(spark):
    p = patterns.ORDER
    rows = [(i, p[0], float(i < 4)) for i in range(5)] + [(10 + i, p[1], 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "source_row_index long, hbm8_pattern string, vaccinated double")
    rates = {r.pattern: r for r in patterns.base_rates(df).collect()}
    assert len(rates) == 9
    assert rates[p[0]].smoothed_rate == pytest.approx((4 + 10 * 0.4) / 15)
    assert rates[p[5]].smoothed_rate == pytest.approx(0.4) and rates[p[5]].n == 0
    loo = {r.source_row_index: r for r in patterns.anchor(df, patterns.base_rates(df), leave_one_out=True).collect()}
    assert loo[0].anchor_probability == pytest.approx(100 * (3 + 10 * 3 / 9) / 14)
    assert patterns.base_rates(df.filter("false")).filter("smoothed_rate = 0.5").count() == 9


def test_missing_scores_are_low(spark):
    df = spark.createDataFrame([(None, None, None)], "motivation_score double, capability_score double, activation_score double")
    t = patterns.fit_thresholds(df, "fixed")
    assert patterns.assign(df, t).first().hbm8_pattern == "Low Motivation / Low Capability / Weak Cue"


def test_describe_spearman_and_weights(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, 100).astype(float), rng.integers(0, 2, 100).astype(float)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, y)] + [(None, 1.0, 1.0)], "x double, vaccinated double, survey_weight double")
    import pandas as pd

    got = stats.describe(df, ["x"]).first()
    assert got.spearman == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank())) and got.missing_rate == pytest.approx(1 / 101)
    w = spark.createDataFrame([(1.0,), (3.0,), (None,), (-1.0,), (float("nan"),)], "w double")
    fixed = [r.fit_weight for r in stats.repair_weights(w, "w", normalise=False).collect()]
    assert fixed == [1.0, 3.0, 2.0, 2.0, 2.0]
