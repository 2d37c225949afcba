from tallyloom.llm import truncation as T

SCHEMA = "src_table string, row_id long, field_name string, source string, value string, n int, cut string"
ENDS = ["the bill was paid", "the clinic had moved", "the risk was high"]
STARTS = ["The case shows mixed cues because", "A recent visit supports the rule since", "Two reminders point to the clinic when"]


def table(spark, extra):
    rows = []
    for i in range(120):
        text = f"{STARTS[i % 3]} {ENDS[(i // 3) % 3]} in {['spring', 'autumn', 'winter'][(i // 9) % 3]}"
        rows.append(("t", i, "f", "s1", text + ("" if i % 6 == 0 else "."), 0, "clash"))
    return spark.createDataFrame(rows + [("t", 1000 + i, "f", "s2", v, 0, "x") for i, v in enumerate(extra)], SCHEMA)


def rules(spark, extra, opt=T.Ends()):
    return {r.row_id - 1000: r.rule for r in T.cut_values(table(spark, extra).drop("cut", "n"), opt).collect() if r.row_id >= 1000}


def test_rules(spark):
    base = f"{STARTS[0]} {ENDS[0]}"
    extra = [
        base + "…", "The case shows mi�", "The case shows mixed \\u20", "The case shows mixed cues,", "The case shows (see AB", "The case shows mixed cues bec",
        base + " in spring", "n/a", "", None, "   ", "No change.", base + " in winter (see AGEP_A)", "The case shows mixed cues because the", "The case shows mixed cues because the clinic...",
    ]
    got = rules(spark, extra)
    # The prefix join comes first: a value with a mark that has a longer copy is a copy.
    assert [got.get(i) for i in (0, 1, 2, 14)] == ["copy", "copy", "mark", "copy"]  # half an escape hides the next letters
    assert [got.get(i) for i in (3, 4)] == ["open"] * 2
    assert got[5] == "copy" and got[13] in ("copy", "end")
    assert got[6] is None and got[7] is None and got[11] is None and got[12] is None
    assert not {8, 9, 10} & set(got)


def test_prefix_search_against_brute_force(spark):
    vals = ["ab", "ab c", "abc", "ab.", "b", "b (see x)", "b more", "c", "c.", "d, e", "d", "zz", "Same start here and more", "Same start here an", "e f g", "e f"]
    df = spark.createDataFrame([("f", v, 1, not v.endswith(".")) for v in vals] + [("other", "zzz more", 1, True)], "field_name string, value string, n int, suspect boolean").withColumn("mark", T.F.lit(False))
    want = {v for v in vals if not v.endswith(".") for w in vals if w.startswith(v) and w != v and (w[len(v)].isalnum() or (w[len(v)] == " " and w[len(v) + 1 : len(v) + 2].isalnum()))}
    for parts in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.value for r in T.longer_copies(df).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_limit_needs_a_pile(spark):
    piled = [(f"{STARTS[1]} {ENDS[0]} and then number {i} of words goes on and on without an end")[:70] for i in range(40)]
    got = rules(spark, piled)
    assert set(got.values()) <= {"limit", "copy", "end"} and len(got) == 40


def test_rates_and_edges(spark):
    df = table(spark, ["The case shows mixed cues bec"] * 3).drop("cut", "n")
    j = T.cut_values(df)
    r = {(x.source): x for x in T.rates(j).collect()}
    assert (r["s2"].n_values, r["s2"].n_cut, r["s1"].n_cut) == (3, 3, 0)
    empty = T.cut_values(df.filter("false"))
    assert empty.count() == 0
    odd = spark.createDataFrame([(None, None, None, None, "w" * 200_000), ("t", 1, "f", None, "Fine.")], "src_table string, row_id long, field_name string, source string, value string")
    assert T.cut_values(odd).count() == 2


def test_words_are_counted_like_a_plain_count(spark):
    """Verdicts of the counting stage against a brute-force count over all values."""
    df = T.signs(table(spark, ["The case shows mixed cues because the", "Two reminders point to the clinic when the bi", "The risk was high", "The risk was high in"]).filter("value is not null"))
    texts = df.groupBy("field_name", "value").agg(T.F.count("*").alias("n"), *[T.F.first(c).alias(c) for c in ("suspect", "stub", "mark")]).filter("not stub")
    got = {r.value for r in T.ending_verdicts(texts, T.Ends()).collect()}
    count, rows = {}, texts.collect()
    for r in rows:
        t = T.tokens(r.value, r.mark) + ["<eov>" if r.suspect else "<break>"]
        for n in (1, 2, 3):
            for i in range(len(t) - n):
                if not any(w.startswith("<") for w in t[i : i + n]) and t[i + n] != "<break>":
                    c = count.setdefault(tuple(t[i : i + n]), [0, 0, 0])
                    c[{"<end>": 1, "<eov>": 2}.get(t[i + n], 0)] += r.n
    want = set()
    for r in rows:
        if not r.suspect:
            continue
        last, best, fragment = T.tokens(r.value), None, False
        for n in range(1, min(3, len(last)) + 1):
            if any(w.startswith("<") for w in last[-n:]):
                break
            inside, stops, ends = count.get(tuple(last[-n:]), [0, 0, 0])
            total = inside + stops + ends
            if n == 1:
                fragment = inside + stops == 0
                best = inside + stops == 0 or stops / (inside + stops) < 0.1
            elif total - r.n >= 3:
                best = (stops + ends - r.n) / (total - r.n) < 0.1
        if fragment or best:
            want.add(r.value)
    assert got == want and len(want) >= 2


def test_endings_that_signs_look_at(spark):
    cases = {
        "So it is.": "stop", "So it is.\"  \n": "stop", "He said 'no.'": "stop", "(see above)": "stop", "with care e.g.": "open", "and so on...": "mark", "cut \\u2": "mark",
        "cut off, ": "open", "list (one, two": "open", "plain words": "suspect", "是的。": "stop", "N / A": "stub", "-- ok --" + " -" * 50: "stub", "---": "stub",
    }
    df = spark.createDataFrame([(k,) for k in cases], "value string")
    for r in T.signs(df).collect():
        want = cases[r.value]
        assert (r.stub, r.mark, r.open) == (want == "stub", want == "mark", want == "open"), r
        assert r.suspect == (want in ("open", "suspect")), r
