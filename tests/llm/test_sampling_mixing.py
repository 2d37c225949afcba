import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing as M
from tallyloom.llm import sampling as S

PATH = ["a", "b"]


def allocation(spark, counts, targets):
    pool = spark.createDataFrame(counts, "a string, b int, n long")
    t = spark.createDataFrame(targets, "plan_id int, a string, b int, target_share double, min_rows int, sample_fraction double")
    return {(r.plan_id, r.a, r.b): r for r in S.allocate(t, pool, PATH).collect()}


def test_unmet_quota_goes_to_siblings_first(spark):
    got = allocation(spark, [("x", 1, 5), ("x", 2, 50), ("y", 1, 45)], [(1, "x", 1, 0.4, 0, 0.5), (1, "x", 2, 0.2, 0, 0.5), (1, "y", 1, 0.2, 0, 0.5), (1, "y", 2, 0.2, 0, 0.5)])
    assert {k[1:]: (r.asked, r.available) for k, r in got.items()} == {("x", 1): (20, 5), ("x", 2): (10, 50), ("y", 1): (10, 45), ("y", 2): (10, 0)}
    # 15 unmet at x/1 go to x/2; 10 unmet at y/2 go to y/1.
    assert {k[1:]: r.quota for k, r in got.items()} == {("x", 1): 5, ("x", 2): 25, ("y", 1): 20, ("y", 2): 0}
    assert [got[(1, "x", 1)].short, got[(1, "y", 2)].short, got[(1, "x", 2)].short] == [True, True, False]
    assert sum(r.unmet for r in got.values()) == 0


def test_then_to_cousins_and_rest_is_reported(spark):
    got = allocation(spark, [("x", 1, 1), ("y", 1, 9)], [(1, "x", 1, 0.9, 0, 1.0), (1, "x", 2, 0.0, 0, 1.0), (1, "y", 1, 0.1, 0, 1.0), (2, "x", 1, None, 50, 1.0)])
    assert got[(1, "y", 1)].quota == 9 and got[(1, "x", 1)].quota == 1
    assert got[(2, "x", 1)].short and got[(2, "x", 1)].quota == 1 and got[(2, "x", 1)].unmet == 49


def test_draw_is_exact_and_stable(spark):
    pool = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("a"), (F.col("id") % 2 + 1).cast("int").alias("b"))
    counts = pool.groupBy(*PATH).agg(F.count("*").alias("n"))
    t = spark.createDataFrame([(p, a, b, 0.25, 1, 0.2) for p in (1, 2) for a in "xy" for b in (1, 2)], "plan_id int, a string, b int, target_share double, min_rows int, sample_fraction double")
    q = S.allocate(t, counts, PATH)
    draw = lambda p: sorted(tuple(r) for r in S.draw(p, q, PATH, "id").collect())
    one = draw(pool.repartition(1))
    assert one == draw(pool.repartition(9)) and len(one) == 1200 and len(set(one)) == 1200
    assert {r[1] for r in one if r[0] == 1} != {r[1] for r in one if r[0] == 2}
    assert S.draw(pool.filter("false"), q, PATH, "id").count() == 0


def test_pattern_spelling(spark):
    df = spark.createDataFrame([("  LOW Motivation|high  Capability / Weak-Cue",), (None,), ("",)], "p string")
    assert [r[0] for r in df.select(S.pattern_key(F.col("p"))).collect()] == ["lowmotivationhighcapabilityweakcue", None, ""]


def sizes(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "tiny").when(F.col("id") % 50 == 2, F.lit(None)).otherwise("other").alias("source"), (F.col("id") % 9).alias("n_tokens"))


def targets(spark):
    return spark.createDataFrame([(1, "hot", 0.5, 2, 0.8), (1, "tiny", 0.3, 3, 0.8), (1, "other", 0.1, 1, 0.8), (1, "absent", 0.1, 9, 0.8), (2, "hot", 1.0, 5, 1.2)],
                                 "mix_id int, source string, target_share double, max_repeats int, budget_fraction double")


def test_mix_meets_budgets_and_caps(spark):
    s = sizes(spark)
    p = M.plan(s, targets(spark))
    rows = {(r.mix_id, r.source): r for r in M.report(p, M.draw(s, p)).collect()}
    total = s.agg(F.sum("n_tokens")).first()[0]
    assert rows[(1, "tiny")].short and rows[(1, "absent")].short and not rows[(1, "hot")].short
    assert rows[(1, "hot")].got_tokens == pytest.approx(0.5 * 0.8 * total, abs=9)
    assert rows[(2, "hot")].got_tokens == pytest.approx(1.2 * total, abs=9)
    tiny = s.filter("source = 'tiny'").agg(F.sum("n_tokens")).first()[0]
    assert rows[(1, "tiny")].got_tokens == 3 * tiny and rows[(1, "tiny")].most_copies == 3
    d = M.draw(s, p).join(targets(spark), ["mix_id", "source"])
    assert d.filter("n_copies > max_repeats or n_copies < 1").count() == 0


def test_weights_raise_inclusion(spark):
    s = sizes(spark).withColumn("weight", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    t = spark.createDataFrame([(1, "hot", 0.1, 1, 1.0)], "mix_id int, source string, target_share double, max_repeats int, budget_fraction double")
    d = M.draw(s, M.plan(s, t)).groupBy((F.col("doc_id") % 2).alias("odd")).count()
    n = {r.odd: r["count"] for r in d.collect()}
    assert n[0] > 2 * n[1]


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "a", "hello world", 5), (2, None, "", 1), (3, "b", None, 1), (4, "b", "word " * 40_000, 1), (5, "b", "x" * 120_000, 1)], "doc_id long, source string, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in M.token_sizes(df).collect()}
    assert 2 <= got[1] <= 4 and got[2] == 0 and got[3] == 0 and 40_000 <= got[4] <= 80_010 and got[5] > 0
    assert M.token_sizes(df.filter("false")).count() == 0
    empty = M.token_sizes(df.filter("false"))
    p = M.plan(empty, targets(spark))
    assert M.draw(empty, p).count() == 0 and M.report(p, M.draw(empty, p)).count() == 5


def test_counts_beyond_ten_billion(spark):
    t = [(1, "a", "x", 0.5, 0, 1.0), (1, "a", "y", 0.3, 0, 1.0), (1, "b", "x", 0.2, 0, 1.0)]
    targets = spark.createDataFrame(t, "plan_id int, p string, q string, target_share double, min_rows int, sample_fraction double")
    counts = spark.createDataFrame([("a", "x", 1_000_000_000), ("a", "y", 9_000_000_000), ("b", "x", 6_000_000_000)], "p string, q string, n long")
    got = S.allocate(targets, counts, ["p", "q"]).collect()
    assert sum(r.quota for r in got) == sum(r.asked for r in got) == 16_000_000_000
    assert all(r.quota <= r.available for r in got)


def test_whole_texts_are_tokenised(spark):
    import base64

    import tiktoken

    path = f"{M.VOCABULARY}/{M.FILE}"
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
    enc = tiktoken.Encoding("own", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Can't stop, l'été  2023!\n\n ", "word " * 12_000, "ab" * 30_000, "naïve_text — 中文 и русский \t\t x", " ", "1234567 89"]
    df = spark.createDataFrame(list(enumerate([*texts, None, " " * 70_000 + "a"])), "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r.n_tokens for r in M.token_sizes(df).collect()}
    assert [got[i] for i in range(len(texts))] == [len(enc.encode_ordinary(t)) for t in texts]
    assert got[len(texts)] == 0 and got[len(texts) + 1] > 1


def test_unequal_weights_meet_the_budget(spark):
    docs = [(i, "s", 10, 100.0 if i < 20 else 1.0 if i % 2 else 3.0) for i in range(1000)] + [(1000, "s", 10, None), (1001, "s", 10, -1.0), (1002, "t", 8000, 0.0)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, weight double")
    targets = spark.createDataFrame([(1, "s", 0.5, 2, 0.5), (2, "s", 0.9, 3, 2.0), (3, "t", 1.0, 2, 0.1)], "mix_id int, source string, target_share double, max_repeats int, budget_fraction double")
    planned = M.plan(sizes, targets)
    drawn = M.draw(sizes, planned)
    r = {x.mix_id: x for x in M.report(planned, drawn).collect()}
    assert abs(r[1].got_tokens - r[1].budget) <= 10 and not r[1].short
    assert r[2].got_tokens == 1000 * 3 * 10 and r[2].got_tokens < r[2].budget
    assert r[3].got_tokens == 0
    n = {x.doc_id: x.n_copies for x in drawn.filter("mix_id = 1").collect()}
    assert all(n[i] == 2 for i in range(20)) and not {1000, 1001} & set(n)
    odd, even = sum(n.get(i, 0) for i in range(21, 1000, 2)), sum(n.get(i, 0) for i in range(20, 1000, 2))
    assert 2.2 < even / odd < 4
