import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import predictor as P
from tallyloom.plans.models import RESULT_COLUMNS, collect_results
from tallyloom.sources import files
from tallyloom.streaming import logs


class Failing:
    def predict(self, prompts):
        raise TimeoutError("request timed out")


class Forbidden:
    def predict(self, prompts):
        raise AssertionError("no call was due")


def test_resume_makes_no_calls(spark, tmp_path):
    prompts = spark.range(20).select(F.col("id").alias("key"), F.lit('{"base_probability": 40}').alias("prompt"))
    log = str(tmp_path / "log")
    bad = P.run_pending(spark, prompts, log, "h", Failing, retries=1)
    assert bad.filter("status = 'error' and attempt_count = 2").count() == 20
    assert bad.select(P.failure_category(F.col("error_message"), F.col("error_type"))).first()[0] == "api_timeout"
    kept = P.run_pending(spark, prompts, log, "h", Forbidden, retry_errors=False)
    assert kept.filter("status = 'error'").count() == 20
    ok = P.run_pending(spark, prompts, log, "h")
    assert ok.filter("status = 'ok' and usage.total_tokens > 0").count() == 20
    again = P.run_pending(spark, prompts, log, "h", Forbidden)
    assert again.filter("status = 'ok'").count() == 20
    moved = P.migrate_log(P.read_log(spark, log), "new", ["h"])
    assert moved.count() == 20 and moved.filter("config_hash = 'new'").count() == 20


def test_validators(spark):
    df = spark.createDataFrame([(60.0, 50.0, 70.0, "higher_than_pattern", ["a", "b", "b"], ["b"], 0.2, "increase", [1.0, 3.0, 0.0, 0.0, 0.0])],
                               "base double, adj double, p double, dir string, ids array<string>, got array<string>, res double, d string, v array<double>")
    r = df.select(
        P.decision(F.col("base"), F.col("adj"), F.col("p"), F.col("dir")).alias("d"), P.gate(F.col("ids"), F.col("got"), F.col("res"), F.col("d")).alias("g"),
        P.vector(F.col("v")).alias("v"), P.probability(F.lit("0.4"), True).alias("q"), P.probability(F.lit("bad")).alias("n"),
        P.reflection(F.lit("Up"), F.lit("increase"), F.array(F.lit(" x "), F.lit("y")), F.lit("rule"), F.lit("70%")).alias("r"),
    ).first()
    assert (r.d.residual_adjustment, r.d.probability_yes, r.d.probability_consistency_corrected) == (30.0, 90.0, True)
    assert (r.g.memory_ids, r.g.apply_correction) == (["b"], True)
    assert (r.v, r.q, r.n) == ([1.0, 2.0, 0.0, 0.0, 0.0], 40.0, None)
    assert r.r.valid and r.r.reflection_confidence == pytest.approx(0.7)
    assert P.resolve_model("Llama-70B", ["vendor/llama-70b", "other"]) == "vendor/llama-70b"
    with pytest.raises(ValueError):
        P.resolve_model("zzz", ["a"])


def test_latest_skips_corrupt_lines(spark, tmp_path):
    p = tmp_path / "log"
    p.mkdir()
    line = lambda seq, status: json.dumps({"config_hash": "h", "key": 1, "status": status, "seq": seq})
    (p / "a.json").write_text("\n".join([line(1, "error"), '{"config_hash": "h", "key"', line(2, "ok"), line(3, "error").replace('"h"', '"other"')]))
    got = P.latest(P.read_log(spark, str(p)), "key", "h").collect()
    assert [(r.key, r.status) for r in got] == [(1, "ok")]


def test_files(spark, tmp_path):
    f = tmp_path / "raw.csv"
    f.write_text("HHX,AGEP_A,EXTRA\nH1,50,x\nH2,bad,y\nH3,,z\n")
    got = files.read_csv(spark, str(f), ["HHX", "AGEP_A"]).orderBy("source_row_index").collect()
    assert [tuple(r) for r in got] == [("H1", 50.0, 0), ("H2", None, 1), ("H3", None, 2)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(f), ["NOPE"])
    with pytest.raises(ValueError):
        files.forbid_columns(spark.range(1).select(F.lit(1).alias("SHTHEPA_A")), ["shthepa_a"])
    run = str(tmp_path / "run")
    h = files.write_config(run, {"a": 1})
    assert files.write_config(run, {"a": 1}) == h
    with pytest.raises(ValueError):
        files.write_config(run, {"a": 2})
    s = tmp_path / "support.json"
    s.write_text(json.dumps([{"source_row_index": i, "label": i % 2} for i in range(8)]))
    mem = spark.range(10).select(F.col("id").alias("source_row_index"), (F.col("id") % 2).cast("int").alias("actual"))
    assert files.read_support(str(s), mem).count() == 8
    with pytest.raises(ValueError):
        files.read_support(str(s), mem.filter("source_row_index > 3"))
    nan = spark.createDataFrame([(float("nan"), 1)], "a double, b int")
    assert json.loads(files.safe_json(nan).first()[0]) == {"a": None, "b": 1}
    files.write_table(nan.withColumn("v", F.lit("x")), str(tmp_path / "out"), by=["v"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_drops_repeats(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/call_log.parquet").schema
    s = logs.distinct_calls(logs.stream_calls(spark, f"{data}/call_log*.parquet", schema).filter("call_id is not null and created_at is not null"), "4000 days")
    q = s.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{data}/call_log.parquet").filter("call_id is not null and created_at is not null").select("call_id").distinct().count()
    assert spark.table("once").count() == batch
    w = logs.append_latest(logs.stream_calls(spark, f"{data}/call_log*.parquet", schema), str(tmp_path / "t"), str(tmp_path / "c"))
    w.processAllAvailable()
    w.stop()
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.parquet(f"{data}/call_log.parquet").count()


def test_collect_results_keeps_the_empty_versions(spark):
    ml = spark.createDataFrame([("with_other_vaccine_history", 75, "logistic", 0.7, 0.8, 0.7, "x")], "scenario string, n_features int, model string, accuracy double, roc_auc double, f1_positive double, source string")
    icl = spark.createDataFrame([("V4", "m", "zero", 10.0, 0.5)], "variant string, model string, method string, test_n double, accuracy double")
    rg = spark.createDataFrame([("v5", "m", "prior", 50.0)], "variant string, model string, method string, threshold double")
    got = {r.result_group: r for r in collect_results({"ml": ml, "icl": icl, "reward_memory": rg}).collect()}
    assert list(got["ml"].asDict()) == RESULT_COLUMNS
    assert (got["ml"].version, got["ml"].method, got["icl"].version, got["reward_memory"].version, got["reward_memory"].selected_threshold) == ("V4", "logistic", None, "V5", "50.0")


def test_gate_answers(spark):
    held = {"a": 0.3, "b": -0.2, "c": 0.1, "d": 0.4}
    rows = [
        ("Yes", "Up", ["a", " b", "c", "d", "x"], "Large", " two\n words ", ["", " E1 "], "high"),
        ("no", "up", ["a"], "strong", None, None, None),
        ("apply", "sideways", ["a"], "weak", "s", [], "0.4"),
        ("true", "down", ["x"], "weak", "s", [], "40"),
        ("true", "down", ["a"], "weak", "s", ["e"], "40"),
        ("true", "increase", ["a"], "odd", "s", ["1", "2", "3", "4", "5", "6", "7"], None),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r, held) for i, r in enumerate(rows)], "i int, a string, d string, ids array<string>, s string, m string, e array<string>, c string, held map<string,double>")
    g = P.gate_answer(*[F.col(c) for c in ("a", "d", "ids", "held", "s", "m", "e", "c")])
    got = [r.g for r in df.select("i", g.alias("g")).orderBy("i").collect()]
    assert tuple(got[0]) == (True, "increase", ["a", "c"], "strong", "two words", ["E1"], 0.8, None)
    assert tuple(got[1]) == (False, "none", [], "none", P.NO_MECHANISM, [], 0.5, None)
    assert [(x.apply_correction, x.error) for x in got[2:4]] == [(False, "no direction"), (False, "no retrieved memories")]
    assert (got[4].apply_correction, got[4].mechanism_summary, got[4].evidence_fields, got[4].confidence) == (False, P.NOT_SUPPORTED, ["e"], 0.4)
    assert (got[5].strength, len(got[5].evidence_fields)) == ("moderate", 6) and not got[6].apply_correction and got[6].error is None


def test_answers_with_several_objects(spark):
    df = spark.createDataFrame([('first {"p": 1, "q": "a"} then {"p": 2} {"z": 1}',), ("none",), (None,)], "t string")
    assert [r.x and r.x.p for r in df.select(P.parse_answer(F.col("t"), {"p": "double", "q": "string"}).alias("x")).collect()] == [2.0, None, None]


def test_row_numbers_of_a_csv_follow_the_file(spark, tmp_path):
    from tallyloom.sources.files import read_csv

    (tmp_path / "a.csv").write_text("HHX,X,Y\n" + "".join(f"h{i},{i},{'bad' if i % 7 == 0 else i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = read_csv(spark, str(tmp_path / "a.csv"), ["HHX", "X", "Y"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.source_row_index for r in got) == list(range(5000)) and all(r.X == r.source_row_index and r.HHX == f"h{r.source_row_index}" for r in got)
    assert sum(r.Y is None for r in got) == 715


def test_quantiles_and_running_sums_against_numpy(spark):
    import numpy as np

    from tallyloom.operators.ranked import cumulate, quantiles

    rng = np.random.default_rng(3)
    x = {"a": np.round(rng.normal(size=501), 2), "b": rng.exponential(size=40) ** 9, "c": np.array([5.0] * 9), "d": np.array([1.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)], "g string, x double")
    got = {r.g: r for r in quantiles(df, ["g"], "x", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    assert set(got) == set(x)
    for g, v in x.items():
        assert [got[g].q1, got[g].m, got[g].q9] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.9])))
    c = df.filter("x = x and x is not null and not isnan(x)").groupBy("g", "x").agg(F.count("*").alias("n"))
    for r in cumulate(c, ["g"], "x", ["n"], bins=16).collect():
        assert r.n_before == (x[r.g] < r.x).sum()
    assert quantiles(df.filter("g = 'e'"), [], "x", {"m": 0.5}).first().m is None


def test_models_are_stored_with_their_configuration(spark, tmp_path):
    calls = []

    def fit():
        calls.append(1)
        return {"weights": spark.range(3), "rates": spark.range(2)}

    path = str(tmp_path / "model")
    for _ in range(2):
        got = files.fit_or_load(path, {"epochs": 3}, fit)
        assert {n: t.count() for n, t in got.items()} == {"weights": 3, "rates": 2}
    assert len(calls) == 1
    with pytest.raises(ValueError):
        files.fit_or_load(path, {"epochs": 4}, fit)
