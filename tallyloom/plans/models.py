"""Queries of fitted models, predictor stages, streaming and result collection (no SQL form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.durable import durable, shared_folder
from tallyloom.operators import memory, models, patterns, predictor, retrieval, scores, splits, stats
from tallyloom.plans.calibration import anchored, profiled, respondents, split_scores
from tallyloom.sources.tables import table
from tallyloom.streaming import logs


def _constructs(spark: SparkSession, d: str) -> DataFrame:
    a = anchored(spark, d).withColumn("anchor", F.col("anchor_probability") / 100)
    return models.construct_frame(a, scores.PROXIES["v4"], ["source_row_index", "vaccinated", "survey_weight", "split", "hbm8_pattern", "anchor"])


def q_nonneg_logit(spark, d):
    """Prior probability of every row from the model of the memory split."""
    c = _constructs(spark, d)
    m = models.nonnegative_logistic(c.filter("split = 'memory'"), "vaccinated")
    return c.select("source_row_index", "split", m.probability().alias("prior"))


def q_oof_residual(spark, d):
    c = _constructs(spark, d).filter("split = 'memory'")
    f = splits.folds(c, ["vaccinated", "hbm8_pattern"], "source_row_index")
    return models.crossfit(f, "vaccinated", "fold", 5).select("source_row_index", "fold", "prior", "residual", "residual_direction")


def q_residual_candidates(spark, d):
    c = _constructs(spark, d).filter("split = 'memory'")
    o = c.withColumn("residual", F.col("vaccinated") - F.col("anchor"))
    return memory.residual_candidates(o, "residual", "hbm8_pattern", "source_row_index").select("source_row_index", "hbm8_pattern", "residual_direction", "abs_residual")


def _reward(spark, d):
    c = _constructs(spark, d)
    r = models.fit_reward(c.filter("split = 'memory'"), "vaccinated", "anchor", patterns.ORDER)
    return models.reward_prior(c, r, "anchor")


def q_reward_prior(spark, d):
    return _reward(spark, d).select("source_row_index", "split", "reward_prior_probability", *[f"contribution_{n}" for n in models.CONSTRUCTS])


def q_reward_revision(spark, d):
    return models.accept_revision(_reward(spark, d).filter("split = 'memory'"), "vaccinated", "anchor", {"threat": 1, "cue": -1})


#: Start of the loadings of COVID, pneumonia and hepatitis A on the five contexts.
LOADINGS = [[0.65, 1.0, 0.55, 0.8, 0.55], [1.0, 0.7, 0.5, 0.95, 0.45], [0.5, 0.7, 0.75, 0.5, 0.7]]


def q_latent_map(spark, d):
    """Latent vectors of all respondents from contextual scores and three observed actions."""
    r = respondents(spark, d)
    ctx = scores.contextual_scores(r)
    from tallyloom.functions.recode import yes_no

    acts = ["shtcvd191_a", "shtpnuev_a", "shthepa_a"]
    a = r.select("source_row_index", *[F.coalesce(yes_no(c), F.lit(0.0)).alias(f"a{i}") for i, c in enumerate(acts)], *[yes_no(c).isNotNull().cast("double").alias(f"w{i}") for i, c in enumerate(acts)])
    x = [c for c in ctx.columns if c != "source_row_index"]
    rows = durable(ctx.join(a, "source_row_index"))
    fitted, _ = models.fit_latent(rows, x, ["a0", "a1", "a2"], ["w0", "w1", "w2"], [1, 1, -1, 1, 1], LOADINGS)
    return models.latent_map(rows, "source_row_index", x, ["a0", "a1", "a2"], ["w0", "w1", "w2"], fitted)


def q_kmeans_medoids(spark, d):
    """Per label, the row nearest to each of four cluster centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    e = e.withColumn("half", F.col("label") % 2)
    out = None
    for half in (0, 1):
        part = e.filter(F.col("half") == half)
        m = KMeans(k=4, seed=42, maxIter=20).fit(part)
        centres = F.create_map(*[x for i, c in enumerate(m.clusterCenters()) for x in (F.lit(i), F.array(*[F.lit(float(v)) for v in c]))])
        p = m.transform(part).withColumn("x", vector_to_array("features")).withColumn("c", centres[F.col("prediction")])
        dist = F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        w = Window.partitionBy("prediction").orderBy("distance", "vec_id")
        best = p.withColumn("distance", dist).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("half", F.col("prediction").alias("cluster"), "vec_id", F.round("distance", 6).alias("distance"))
        out = best if out is None else out.unionByName(best)
    return out


def q_classifiers(spark, d):
    """Test probabilities of ``logistic`` and ``linear_svc`` on imputed, scaled scores; no query runs the other classifiers."""
    s = split_scores(spark, d)
    f = retrieval.fit_features(s, s.filter("split = 'memory'"), scores.PROXIES["v4"], [])
    f = f.select(F.col("source_row_index").alias("id"), "x", F.col("vaccinated").cast("int").alias("y"), "split")
    out = None
    for name in ("logistic", "linear_svc"):
        p = models.run_classifier(f.filter("split = 'memory'"), f.filter("split = 'test'"), name).withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def q_stub_decisions(spark, d):
    """One predictor stage over all test rows: prompts, calls, log, validated decisions."""
    a = anchored(spark, d).filter("split = 'test'")
    profile = F.struct(*[F.round(c, 2).alias(c) for c in ("motivation_score", "capability_score", "activation_score")])
    prompts = a.select(F.col("source_row_index").alias("key"), "anchor_probability", predictor.prompt("Adjust the base probability.", F.col("anchor_probability"), profile).alias("prompt"))
    log = shared_folder(spark, "calls")
    got = predictor.run_pending(spark, prompts, log, "stub-1")
    body = predictor.parse_answer(F.col("text"), {"probability_yes": "double", "residual_adjustment": "double", "deviation_direction": "string"})
    j = got.join(prompts.select("key", "anchor_probability"), "key").withColumn("a", body)
    v = predictor.decision(F.col("anchor_probability"), F.col("a.residual_adjustment"), F.col("a.probability_yes"), F.coalesce("a.deviation_direction", F.lit("")))
    return j.select(F.col("key").alias("source_row_index"), "status", "attempt_count", v.alias("v")).select("source_row_index", "status", "attempt_count", "v.*")


def q_memory_retrieval(spark, d):
    """Rules of the memory table for every respondent with scores, as in the valued retrieval."""
    s, _ = profiled(spark, d)
    f = retrieval.fit_features(s, s.filter("split = 'memory'"), scores.PROXIES["v4"], [])
    rows = f.select(F.col("source_row_index").alias("id"), "x", F.col("hbm8_pattern").alias("pattern"))
    rows = durable(rows)
    m = table(spark, d, "memory_items").filter("memory_id is not null").dropDuplicates(["memory_id"])
    m = m.select("memory_id", F.col("source_row_index").alias("id"), "correction_direction", F.coalesce("estimated_memory_value", F.lit(0.0)).alias("memory_value"))
    m = durable(m.join(rows, "id").select(F.col("memory_id").alias("id"), "x", "pattern", "correction_direction", "memory_value", F.lit(0.0).alias("q_value")))
    near = retrieval.top_similar(rows, m, [("x", 0.9, True)], 20, least=0.45, same_pattern=0.1, drop_self=False)
    return retrieval.retrieve_valued(near, m, rows).select("id", "source_id", "similarity", "score", "pick")


def q_stream_usage(spark, d):
    """Calls, errors and tokens per model and hour, by a stream that runs over the table once."""
    source = table(spark, d, "call_log")
    folder = f"{d}/call_log.parquet"
    import os

    glob = folder if os.path.isdir(folder) else f"{d}/call_log*.parquet"
    stream = logs.hourly_usage(logs.stream_calls(spark, glob, source.schema), "400 days")
    name = f"usage_{abs(hash((d, spark.sparkContext.applicationId))) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def collect_results(frames: dict[str, DataFrame]) -> DataFrame:
    """Result tables of all experiment groups in one schema.

    ``frames``: group name to table. Tables with a ``scenario`` column get their version from it
    and the model as method. Tables with a ``threshold`` column have their variant, in capitals, as
    version. Other tables keep a variant column for themselves, so their version stays empty.
    """
    out = []
    for group, df in frames.items():
        names = {"scenario": "feature_setting", "f1_positive": "f1"}
        final, by_scenario = "threshold" in df.columns, "scenario" in df.columns
        if final:
            names |= {"variant": "version", "threshold": "selected_threshold"}
        g = df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns]).withColumn("result_group", F.lit(group))
        if by_scenario:
            setting = F.col("feature_setting")
            g = g.withColumns({"version": F.when(setting == "with_other_vaccine_history", "V4").when(setting == "without_other_vaccine_history", "V5"), "method": F.col("model")})
        if final:
            g = g.withColumn("version", F.upper("version"))
        if final or by_scenario:
            g = g.withColumn("status", F.lit("complete"))
        out.append(g.select(*[F.col(c).cast("string").alias(c) for c in g.columns]))
    return stats.union_aligned(out, RESULT_COLUMNS)


#: Columns of the collected result table, in order.
RESULT_COLUMNS = [
    "result_group", "version", "feature_setting", "model", "method", "test_n", "selected_threshold", "accuracy",
    "balanced_accuracy", "roc_auc", "f1", "status", "note", "source",
]

QUERIES = {
    f.__name__: f
    for f in (
        q_nonneg_logit, q_oof_residual, q_residual_candidates, q_reward_prior, q_reward_revision, q_latent_map, q_kmeans_medoids,
        q_classifiers, q_stub_decisions, q_memory_retrieval, q_stream_usage,
    )
}
SQL: dict[str, str] = {}
