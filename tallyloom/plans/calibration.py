"""Queries over whole tables: recoding, scores, patterns, splits, metrics, retrieval, memories.

Each query is registered with its SQL counterpart where SQL can express it. Doubles are rounded to
six places on both sides, because engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import recode as R
from tallyloom.functions.durable import durable
from tallyloom.functions import text as X
from tallyloom.operators import memory, metrics, patterns, predictor, retrieval, scores, splits, stats
from tallyloom.sources.tables import current_rows, nan_to_null, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Shared pieces. SQL fragments restate them independently.

CUR = """r AS (SELECT * FROM respondents WHERE source_row_index IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY loaded_at DESC NULLS LAST) = 1)"""
#: hash32 of id with seed 42.
H = "(((({0} % 2147483648) * 2654435761 + 1701126) % 4294967296))"
HASH = f"((({H} >> 7) * 2654435761 + {H}) % 4294967296)"


def clean(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}"


PROF = f"""s0 AS (SELECT * FROM hbm_scores WHERE source_row_index IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY scored_at DESC NULLS LAST) = 1),
s1 AS (SELECT source_row_index, {', '.join(clean(c) for c in ('vaccinated', 'survey_weight', 'motivation_score', 'capability_score',
    'activation_score', *scores.PROXIES["v4"]))} FROM s0),
s AS (SELECT *, {HASH.format('source_row_index')} AS h FROM s1 WHERE vaccinated IN (0, 1)),
s2 AS (SELECT *, row_number() OVER (PARTITION BY vaccinated ORDER BY h, source_row_index) - 1 AS r0,
       count(*) OVER (PARTITION BY vaccinated) AS n0 FROM s),
sp AS (SELECT *, CASE WHEN r0 < round(n0 * 0.4e0) THEN 'memory' WHEN r0 < round(n0 * 0.6000000000000001e0) THEN 'calibration' ELSE 'test' END AS split FROM s2),
th AS (SELECT median(motivation_score) AS tm, median(capability_score) AS tc, median(activation_score) AS ta FROM sp WHERE split = 'memory'),
prof AS (SELECT sp.*, concat(CASE WHEN motivation_score >= tm THEN 'High' ELSE 'Low' END, ' Motivation / ',
    CASE WHEN capability_score >= tc THEN 'High' ELSE 'Low' END, ' Capability / ', CASE WHEN activation_score >= ta THEN 'Strong' ELSE 'Weak' END, ' Cue') AS pattern FROM sp, th),
ov AS (SELECT count(*) AS an, sum(vaccinated) AS ay, sum(vaccinated) / count(*) AS o FROM prof WHERE split = 'memory'),
pr AS (SELECT pattern, count(*) AS n, sum(vaccinated) AS yes FROM prof WHERE split = 'memory' GROUP BY pattern),
sc AS (SELECT prof.*, 100 * CASE WHEN n > 0 THEN (yes + 10 * o) / (n + 10) ELSE o END AS p
       FROM prof CROSS JOIN ov LEFT JOIN pr USING (pattern))"""
#: Metrics of a confusion table (tn, fp, fn, tp as doubles) in SQL.
RATES = """(tp + tn) / (tp + tn + fp + fn) AS accuracy,
    CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / nullif(tn + fp, 0) END AS balanced_accuracy,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
    tn / nullif(tn + fp, 0) AS specificity, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"""


def respondents(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "respondents"), "source_row_index", F.col("loaded_at").desc_nulls_last())


def split_scores(spark: SparkSession, d: str) -> DataFrame:
    """Current scores with an outcome, split by outcome into memory, calibration and test."""
    cols = ["source_row_index", "vaccinated", "survey_weight", "motivation_score", "capability_score", "activation_score", *scores.PROXIES["v4"]]
    s = current_rows(table(spark, d, "hbm_scores").select(*cols, "scored_at"), "source_row_index", F.col("scored_at").desc_nulls_last())
    s = nan_to_null(s.drop("scored_at")).filter(F.col("vaccinated").isin(0.0, 1.0))
    # Fitted state must come from one fixed split: it is stored before anything is fitted on it.
    return durable(splits.three_way(s, ["vaccinated"], "source_row_index"))


def profiled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores with patterns from thresholds of the memory split, and the base rates."""
    s = split_scores(spark, d)
    p = patterns.assign(s, durable(patterns.fit_thresholds(s.filter("split = 'memory'"))))
    return p, patterns.base_rates(p.filter("split = 'memory'"))


def anchored(spark: SparkSession, d: str) -> DataFrame:
    p, rates = profiled(spark, d)
    return durable(patterns.anchor(p, rates))  # read by every search and metric


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Each call once (the line sent last), answered calls with a usable probability."""
    c = table(spark, d, "call_log").select("call_id", "ingested_at", "status", "model", "variant", "method", "phase", "source_row_index", "actual", "probability_yes", "created_at", "config_hash")
    return current_rows(c, "call_id", F.col("ingested_at").desc_nulls_last())


CALLS = """c AS (SELECT * FROM call_log WHERE call_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ingested_at DESC NULLS LAST) = 1),
ok AS (SELECT * FROM c WHERE status = 'ok' AND actual IN (0, 1) AND probability_yes IS NOT NULL AND NOT isnan(probability_yes))"""


def answered(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).filter((F.col("status") == "ok") & F.col("actual").isin(0, 1) & F.col("probability_yes").isNotNull() & ~F.isnan("probability_yes"))


# Recoding and scores


def _yn(c: str) -> str:
    return f"(CASE {c} WHEN 1 THEN 1e0 WHEN 2 THEN 0e0 END)"


def _map(c: str, codes: dict) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN {k} THEN {float(v)}e0" for k, v in codes.items()) + " END)"


AGE = "(CASE WHEN isnan(agep_a) OR agep_a IN (97, 98, 99) THEN NULL ELSE agep_a END)"
MONTHS = "(CASE WHEN hinotmyr_a IS NULL OR isnan(hinotmyr_a) OR hinotmyr_a IN (97, 98, 99) THEN NULL ELSE least(greatest(hinotmyr_a, 0), 12) END / 12)"
_CH = scores.CHRONIC
COUNT = f"(CASE WHEN coalesce({', '.join(_yn(c) for c in _CH)}) IS NOT NULL THEN {' + '.join(f'coalesce({_yn(c)}, 0)' for c in _CH)} END)"
_WELL = f"coalesce({_map('wellvis_a', {0: 0, 1: 1, 2: 0.65, 3: 0.4, 4: 0.2, 5: 0.05, 6: 0})}, {_yn('wellness_a')})"
_LAST = _map("lastdr_a", {0: 0, 1: 1, 2: 0.5, 3: 0.25, 4: 0.1, 5: 0, 6: 0})
_USUAL = _map("usualpl_a", {1: 1, 2: 0, 3: 0.6})
_RETAIL = f"greatest({_map('retailhc12mtc_a', {0: 0, 1: 0.5, 2: 1, 3: 1, 4: 1, 5: 1})}, 0.6e0 * {_yn('virapp12m_a')})"
_ACUTE = f"greatest(CASE WHEN urgcc12mtc_a IN (0,1,2,3,4,5) THEN CASE WHEN urgcc12mtc_a > 0 THEN 1e0 ELSE 0e0 END END, CASE WHEN emerg12mtc_a IN (0,1,2,3,4) THEN CASE WHEN emerg12mtc_a > 0 THEN 1e0 ELSE 0e0 END END, {_yn('hospongt_a')})"
_ITEM = lambda c: f"CASE WHEN {_yn(c)} IS NULL AND accssint_a = 2 THEN 0e0 ELSE {_yn(c)} END"


def _mean(*parts: str) -> str:
    return f"(({' + '.join(f'coalesce({p}, 0)' for p in parts)}) / nullif({' + '.join(f'(({p}) IS NOT NULL)::INT' for p in parts)}, 0))"


_SECTIONS = {
    "threat": [
        (f"(CASE WHEN {AGE} < 50 THEN 0e0 WHEN {AGE} < 65 THEN 0.45e0 WHEN {AGE} < 75 THEN 0.75e0 WHEN {AGE} >= 75 THEN 1e0 END)", 0.25),
        (_map("phstat_a", {1: 0, 2: 0.15, 3: 0.35, 4: 0.75, 5: 1}), 0.20),
        (f"(CASE {COUNT} WHEN 0 THEN 0e0 WHEN 1 THEN 0.35e0 WHEN 2 THEN 0.6e0 WHEN 3 THEN 0.8e0 ELSE CASE WHEN {COUNT} >= 4 THEN 1e0 END END)", 0.35),
        (f"greatest({_yn('anydiff_a')}, {_yn('disab3_a')})", 0.10),
        (_yn("hlthcond_a"), 0.10),
    ],
    "barrier": [
        (f"greatest(1 - {_yn('hicov_a')}, {_yn('notcov_a')}, 0.7e0 * {_yn('hinotyr_a')}, {MONTHS}, {_yn('rsnhicost_a')}, 0.5e0 * {_yn('histopcost_a')})", 0.25),
        (f"greatest({_yn('medng12m_a')}, 0.8e0 * {_yn('meddl12m_a')}, 0.8e0 * {_yn('rxdg12m_a')}, 0.6e0 * {_yn('rxdl12m_a')})", 0.35),
        (f"greatest({_yn('paynobllnw_a')}, 0.7e0 * {_yn('paybll12m_a')}, {_map('payworry_a', {1: 0.7, 2: 0.35, 3: 0})}, 0.2e0 * {_yn('prdeduc1_a')}, 0.2e0 * {_yn('prdeduc2_a')})", 0.20),
        (_yn("transpor_a"), 0.10),
        (_map("comdiff_a", {1: 0, 2: 0.33, 3: 0.67, 4: 1}), 0.10),
    ],
}
_SETTING = _map("usplkind_a", {1: 1, 2: 0.7, 3: 0.2, 4: 1, 5: 0.5, 6: 0.3})
_NET = _mean(_yn("accssint_a"), _yn("accsshom_a"))
_TALK = _map("comdiff_a", {1: 1, 2: 0.67, 3: 0.33, 4: 0})
_V4 = _SECTIONS | {
    "second": [
        (f"(CASE WHEN shtcvd191_a = 2 THEN 0e0 WHEN shtcvd191_a = 1 THEN CASE shtcvd19nm2_a WHEN 2 THEN 0.85e0 WHEN 3 THEN 1e0 ELSE 0.7e0 END END)", 0.50),
        (f"(CASE WHEN {AGE} >= 65 OR {COUNT} >= 1 OR hlthcond_a = 1 THEN {_yn('shtpnuev_a')} END)", 0.25),
        (f"(CASE WHEN {AGE} >= 50 THEN CASE WHEN shingrix3_a = 1 THEN 1e0 ELSE {_yn('shtshingl1_a')} END END)", 0.25),
    ],
    "cue": [(_LAST, 0.35), (_WELL, 0.35), (_RETAIL, 0.15), (f"0.5e0 * {_ACUTE}", 0.15)],
    "navigation": [(_USUAL, 0.30), (_SETTING, 0.10), (_NET, 0.15), (_mean(_ITEM("hitlook_a"), _ITEM("hitcomm_a"), _ITEM("hittest_a")), 0.25), (_yn("virapp12m_a"), 0.10), (_TALK, 0.10)],
}
_V5 = _SECTIONS | {
    "second": [(_WELL, 0.45), (_yn("hitlook_a"), 0.20), (_yn("hitcomm_a"), 0.20), (_yn("hittest_a"), 0.15)],
    "cue": [(_LAST, 0.45), (_RETAIL, 0.25), (f"0.45e0 * {_ACUTE}", 0.10), (_USUAL, 0.20)],
    "navigation": [(_USUAL, 0.35), (_SETTING, 0.15), (_NET, 0.20), (_yn("virapp12m_a"), 0.10), (_TALK, 0.20)],
}


def _score_sql(sections: dict, names: list[str], evidence: dict, bonus: bool) -> str:
    order = ("threat", "second", "barrier", "cue", "navigation")
    parts = ", ".join(f"{c} AS {s}{i}" for s in order for i, (c, _) in enumerate(sections[s]))
    outs = []
    for s, name in zip(order, names):
        w = [w for _, w in sections[s]]
        cols = [f"{s}{i}" for i in range(len(w))]
        mean = f"({' + '.join(f'coalesce({c} * {v}e0, 0)' for c, v in zip(cols, w))}) / nullif({' + '.join(f'CASE WHEN {c} IS NULL THEN 0e0 ELSE {v}e0 END' for c, v in zip(cols, w))}, 0)"
        extra = " + CASE WHEN hep = 1 THEN 0.25e0 ELSE 0e0 END" if bonus and s == "second" else ""
        n = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
        hi, mid = evidence[s]
        outs.append(f"least(greatest(CASE WHEN ({mean}) IS NOT NULL THEN 5 * ({mean}){extra} END, CASE WHEN ({mean}) IS NOT NULL THEN 0 END), CASE WHEN ({mean}) IS NOT NULL THEN 5 END) AS {name}")
        outs.append(f"CASE WHEN {n} >= {hi} THEN 'strong' WHEN {n} >= {mid} THEN 'moderate' WHEN {n} >= 1 THEN 'weak' ELSE 'none' END AS {s}_evidence_strength")
    rest = f"{names[0]}, {names[1]}, {names[2]}, {names[3]}, {names[4]}".split(", ")
    rounds = ", ".join(f"round({n}, 6) AS {n}" for n in rest) + ", " + ", ".join(f"{s}_evidence_strength" for s in order)
    return f"""WITH {CUR}, k AS (SELECT source_row_index, shthepa_a AS hep, {parts} FROM r), z AS (SELECT source_row_index, {', '.join(outs)} FROM k)
        SELECT source_row_index, {rounds}, round({_mean(names[0], names[1])}, 6) AS motivation_score,
        round({_mean(f'(5 - {names[2]})', names[4])}, 6) AS capability_score, round({names[3]}, 6) AS activation_score FROM z"""


def _scores(spark: SparkSession, d: str, variant: str) -> DataFrame:
    s = scores.score_table(respondents(spark, d), variant)
    keep = ["source_row_index", *scores.PROXIES[variant], *[f"{x}_evidence_strength" for x in ("threat", "second", "barrier", "cue", "navigation")], "motivation_score", "capability_score", "activation_score"]
    return rounded(s.select(*keep))


@query(_score_sql(_V4, scores.PROXIES["v4"], scores.EVIDENCE["v4"], True))
def q_scores_v4(spark, d):
    return _scores(spark, d, "v4")


@query(_score_sql(_V5, scores.PROXIES["v5"], scores.EVIDENCE["v5"], False))
def q_scores_v5(spark, d):
    return _scores(spark, d, "v5")


def _context_sql() -> str:
    v = {0: 0, 1: 1, 2: 0.65, 3: 0.45, 4: 0.25, 5: 0.1, 6: 0}
    visits, use = {0: 0, 1: 0.35, 2: 0.65, 3: 1}, _map("usualpl_a", {1: 1, 2: 0, 3: 0.45})
    talk, last, well = _map("comdiff_a", {1: 0, 2: 0.35, 3: 0.7, 4: 1}), _map("lastdr_a", v), _map("wellvis_a", v)
    y = lambda *cs: [_yn(c) for c in cs]
    lists = {
        "threat": [f"least(greatest(({AGE} - 18) / 67, CASE WHEN {AGE} IS NOT NULL THEN 0 END), CASE WHEN {AGE} IS NOT NULL THEN 1 END)", _map("phstat_a", {1: 0, 2: 0.15, 3: 0.35, 4: 0.7, 5: 1}), f"least(coalesce({COUNT}, 0) / 5, 1)",
                   *y("anydiff_a", "disab3_a", "hlthcond_a"), _map("bmicat_a", {1: 0.25, 2: 0, 3: 0.35, 4: 0.7}), _map("smkcigst_a", {1: 1, 2: 0.75, 3: 0, 4: 0.35})],
        "preventive": [*y("wellness_a"), well, last, use, *y("hitlook_a", "hitcomm_a", "hittest_a", "virapp12m_a")],
        "barrier": [f"1 - {_yn('hicov_a')}", *y("notcov_a", "hinotyr_a"), MONTHS, *y("rsnhicost_a", "histopcost_a", "meddl12m_a", "medng12m_a", "rxdl12m_a", "rxdg12m_a"), _map("payworry_a", {1: 0, 2: 0.25, 3: 0.5, 4: 0.75, 5: 1}), *y("paybll12m_a", "paynobllnw_a", "transpor_a"), talk],
        "cue": [last, *y("wellness_a"), well, _map("retailhc12mtc_a", visits), *y("virapp12m_a"), _map("urgcc12mtc_a", visits), _map("emerg12mtc_a", visits), *y("hospongt_a"), use],
        "navigation": [use, _map("usplkind_a", {1: 1, 2: 0.55, 3: 0.2, 4: 0.8, 5: 0.45, 6: 0.15}), *y("accssint_a", "accsshom_a", "hitlook_a", "hitcomm_a", "hittest_a"), f"1 - {talk}"],
    }
    return f"WITH {CUR} SELECT source_row_index, " + ", ".join(f"round(2 * coalesce({_mean(*v)}, 0.5e0) - 1, 6) AS {k}_context" for k, v in lists.items()) + " FROM r"


@query(_context_sql())
def q_scores_context(spark, d):
    return rounded(scores.contextual_scores(respondents(spark, d)))


@query(f"""WITH {CUR} SELECT region, count(*) AS n, count({_yn('hypev_a')}) AS n_known, round(avg({_yn('hypev_a')}), 6) AS rate,
    round(sum({_yn('shtflu12m_a')} * wtfa_a) FILTER (wtfa_a > 0 AND NOT isnan(wtfa_a)) / sum(wtfa_a) FILTER (wtfa_a > 0 AND NOT isnan(wtfa_a) AND {_yn('shtflu12m_a')} IS NOT NULL), 6) AS weighted_rate,
    round(avg({AGE}), 6) AS mean_age FROM (SELECT * REPLACE (CASE WHEN region IN (1, 2, 3, 4) THEN region END AS region) FROM r) GROUP BY region""")
def q_recode(spark, d):
    r = respondents(spark, d).withColumn("region", R.valid("region", (1, 2, 3, 4)))
    return rounded(r.groupBy("region").agg(
        F.count("*").alias("n"), F.count(R.yes_no("hypev_a")).alias("n_known"), F.avg(R.yes_no("hypev_a")).alias("rate"),
        stats.weighted_mean(R.yes_no("shtflu12m_a"), F.col("wtfa_a")).alias("weighted_rate"), F.avg(scores.age()).alias("mean_age"),
    ))


@query(f"""WITH {CUR} SELECT source_row_index, CASE phstat_a WHEN 1 THEN 'excellent' WHEN 2 THEN 'very good' WHEN 3 THEN 'good' WHEN 4 THEN 'fair' WHEN 5 THEN 'poor'
    ELSE CASE WHEN NOT isnan(phstat_a) THEN 'code ' || CAST(trunc(phstat_a) AS BIGINT) END END AS health,
    CASE WHEN {AGE} < 50 THEN '<50' WHEN {AGE} < 65 THEN '50-65' WHEN {AGE} < 75 THEN '65-75' WHEN {AGE} >= 75 THEN '>=75' END AS age_band FROM r""")
def q_labels(spark, d):
    labels = {1: "excellent", 2: "very good", 3: "good", 4: "fair", 5: "poor"}
    return respondents(spark, d).select("source_row_index", R.code_label("phstat_a", labels).alias("health"), R.band_label(scores.age(), (50, 65, 75)).alias("age_band"))


@query()
def q_profile_json(spark, d):
    r = respondents(spark, d)
    return scores.profile_json(r, {"risk": ["agep_a", "phstat_a", *_CH], "access": ["hicov_a", "usualpl_a"]})


@query(f"""WITH {CUR} SELECT source_row_index, {' + '.join(f'coalesce(({c} = 1)::INT, 0)' for c in _CH)} AS n_conditions FROM r""")
def q_active_conditions(spark, d):
    r = respondents(spark, d)
    return r.select("source_row_index", F.size(scores.active_conditions({c: c for c in _CH})).alias("n_conditions"))


# Patterns, rates, anchors


@query(f"WITH {PROF} SELECT pattern AS hbm8_pattern, split, count(*) AS n, round(avg(vaccinated), 6) AS rate FROM prof GROUP BY ALL")
def q_patterns(spark, d):
    p, _ = profiled(spark, d)
    return rounded(p.groupBy("hbm8_pattern", "split").agg(F.count("*").alias("n"), F.avg("vaccinated").alias("rate")))


@query(f"""WITH {PROF}, names AS (SELECT concat(m, ' Motivation / ', c, ' Capability / ', a, ' Cue') AS pattern
    FROM (VALUES ('High'), ('Low')) x(m), (VALUES ('High'), ('Low')) y(c), (VALUES ('Strong'), ('Weak')) z(a))
    SELECT pattern, coalesce(n, 0) AS n, coalesce(yes, 0e0) AS yes, round(CASE WHEN n > 0 THEN yes / n ELSE o END, 6) AS raw_rate,
    round(CASE WHEN n > 0 THEN (yes + 10 * o) / (n + 10) ELSE o END, 6) AS smoothed_rate FROM names LEFT JOIN pr USING (pattern), ov
    UNION ALL SELECT '__overall__', an, ay, round(o, 6), round(o, 6) FROM ov""")
def q_base_rates(spark, d):
    return rounded(profiled(spark, d)[1])


@query(f"""WITH {PROF} SELECT source_row_index, round(100 * CASE WHEN n <= 1 OR an <= 1 THEN o ELSE (yes - vaccinated + 10 * (ay - vaccinated) / (an - 1)) / (n - 1 + 10) END, 6) AS anchor_probability,
    greatest(n - 1, 0) AS anchor_n FROM prof JOIN pr USING (pattern), ov WHERE split = 'memory'""")
def q_anchor_loo(spark, d):
    p, rates = profiled(spark, d)
    a = patterns.anchor(p.filter("split = 'memory'"), rates, leave_one_out=True)
    return rounded(a.select("source_row_index", "anchor_probability", "anchor_n"))


_WM = "sum({0} * survey_weight) FILTER (survey_weight > 0 AND {0} IS NOT NULL) / sum(survey_weight) FILTER (survey_weight > 0 AND {0} IS NOT NULL)"


@query(f"""WITH {PROF}, a AS (SELECT pattern AS hbm8_pattern, count(vaccinated) AS n, sum(vaccinated) AS yes, count(vaccinated) - sum(vaccinated) AS "no", avg(vaccinated) AS rate,
    {_WM.format('vaccinated')} AS weighted_rate, avg(motivation_score) AS mean_motivation_score, avg(capability_score) AS mean_capability_score FROM prof GROUP BY 1)
    SELECT hbm8_pattern, n, yes, "no", round(rate, 6) AS rate, round(weighted_rate, 6) AS weighted_rate, round(mean_motivation_score, 6) AS mean_motivation_score,
    round(mean_capability_score, 6) AS mean_capability_score, rank() OVER (ORDER BY rate DESC NULLS LAST) AS rank_rate, rank() OVER (ORDER BY weighted_rate DESC NULLS LAST) AS rank_weighted_rate FROM a""")
def q_pattern_summary(spark, d):
    return rounded(stats.pattern_summary(profiled(spark, d)[0], "hbm8_pattern", ["motivation_score", "capability_score"]))


@query(f"""WITH {PROF}, l AS (SELECT vaccinated, survey_weight, 'motivation_score' AS score, motivation_score AS x FROM s UNION ALL SELECT vaccinated, survey_weight, 'structural_barrier_proxy', structural_barrier_proxy FROM s)
    SELECT score, CASE WHEN x < 1 THEN '<1' WHEN x < 2 THEN '1-2' WHEN x < 3 THEN '2-3' WHEN x < 4 THEN '3-4' ELSE '>=4' END AS band, count(vaccinated) AS n,
    round(avg(vaccinated), 6) AS rate, round({_WM.format('vaccinated')}, 6) AS weighted_rate FROM l WHERE x IS NOT NULL GROUP BY 1, 2""")
def q_band_summary(spark, d):
    return rounded(stats.band_summary(split_scores(spark, d), ["motivation_score", "structural_barrier_proxy"]))


DESCRIBED = ["motivation_score", "capability_score", "activation_score", *scores.PROXIES["v4"]]
_LONG = " UNION ALL ".join(f"SELECT vaccinated AS y, survey_weight, '{c}' AS score, {c} AS x FROM s" for c in DESCRIBED)


@query(f"""WITH {PROF}, l AS ({_LONG}),
    k AS (SELECT score, x, y, rank() OVER (PARTITION BY score ORDER BY x) + (count(*) OVER (PARTITION BY score, x) - 1) / 2e0 AS rx,
          rank() OVER (PARTITION BY score ORDER BY y) + (count(*) OVER (PARTITION BY score, y) - 1) / 2e0 AS ry FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
    sp2 AS (SELECT score, corr(rx, ry) AS spearman FROM k GROUP BY score)
    SELECT score, count(x) AS n, round(1 - count(x) / count(*), 6) AS missing_rate, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
    round(quantile_cont(x, 0.25), 6) AS p25, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max, round(corr(x, y), 6) AS pearson,
    round({_WM.format('x')}, 6) AS weighted_mean, round(any_value(spearman), 6) AS spearman FROM l JOIN sp2 USING (score) GROUP BY score""")
def q_describe(spark, d):
    return rounded(stats.describe(split_scores(spark, d), DESCRIBED))


# Splits and samples


@query(f"WITH {PROF} SELECT source_row_index, vaccinated, split FROM sp")
def q_split(spark, d):
    return split_scores(spark, d).select("source_row_index", "vaccinated", "split")


@query(f"""WITH {PROF} SELECT source_row_index, CAST((row_number() OVER (PARTITION BY vaccinated, pattern ORDER BY h, source_row_index) - 1) % 5 AS INT) AS fold FROM prof WHERE split = 'memory'""")
def q_folds(spark, d):
    p, _ = profiled(spark, d)
    return splits.folds(p.filter("split = 'memory'"), ["vaccinated", "hbm8_pattern"], "source_row_index").select("source_row_index", "fold")


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT *, n / sum(n) OVER () * 500 AS e FROM c),
    f AS (SELECT *, floor(round(e, 9)) AS f FROM e), g AS (SELECT *, row_number() OVER (ORDER BY round(e - f, 9) DESC, o_orderpriority, o_orderstatus) AS k, 500 - sum(f) OVER () AS rest FROM f)
    SELECT o_orderpriority, o_orderstatus, n, CAST(f + (k <= rest)::INT AS BIGINT) AS quota FROM g""")
def q_allocation(spark, d):
    c = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return splits.allocate(c, "n", 500, ["o_orderpriority", "o_orderstatus"])


_OH = HASH.format("o_orderkey")


@query(f"""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), q AS (SELECT *, least(greatest(round(n * 300 / sum(n) OVER ()), 1), n) AS quota FROM c),
    o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_OH}, o_orderkey) - 1 AS r0 FROM orders)
    SELECT o_orderkey, o_orderstatus FROM o JOIN q USING (o_orderstatus) WHERE r0 < quota""")
def q_downsample(spark, d):
    return splits.downsample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 300)


@query(f"""WITH {PROF} SELECT source_row_index, split, row_number() OVER (ORDER BY CASE split WHEN 'memory' THEN 0 WHEN 'calibration' THEN 1 ELSE 2 END, source_row_index) - 1 AS data_idx FROM sp""")
def q_data_index(spark, d):
    return splits.order_splits(split_scores(spark, d)).select("source_row_index", "split", "data_idx")


# Metrics and searches


def _metric_sql(src: str, y: str, p: str, t: str, by: str, w: str = "1e0") -> str:
    """Metric bundle in SQL: ranks from distinct scores."""
    part, group, keys = f"PARTITION BY {by}", f"GROUP BY {by}", f"{by}, "
    return f"""m AS (SELECT {keys}{y} AS y, CAST({p} AS DOUBLE) AS p, {w} AS w, {t} AS t FROM {src}),
    cf AS (SELECT {keys}count(*) AS n, sum(w) FILTER (p < t AND y = 0) AS tn0, sum(w) FILTER (p >= t AND y = 0) AS fp0, sum(w) FILTER (p < t AND y = 1) AS fn0, sum(w) FILTER (p >= t AND y = 1) AS tp0,
        sum(w * pow(least(greatest(p / 100, 1e-6), 1 - 1e-6) - y, 2)) / sum(w) AS brier,
        sum(-w * (y * ln(least(greatest(p / 100, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p / 100, 1e-6), 1 - 1e-6)))) / sum(w) AS log_loss FROM m {group}),
    cc AS (SELECT * EXCLUDE (tn0, fp0, fn0, tp0), coalesce(tn0, 0) AS tn, coalesce(fp0, 0) AS fp, coalesce(fn0, 0) AS fn, coalesce(tp0, 0) AS tp FROM cf),
    g AS (SELECT {keys}p, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y = 0), 0) AS neg FROM m GROUP BY {keys}p),
    w2 AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
        sum(pos) OVER ({part} ORDER BY p DESC) AS ctp, sum(neg) OVER ({part} ORDER BY p DESC) AS cfp FROM g),
    rk AS (SELECT {keys}sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc, CASE WHEN sum(neg) > 0 THEN sum(pos * ctp / (ctp + cfp)) / nullif(sum(pos), 0) END AS average_precision FROM w2 {group})"""


_COLS = ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "brier", "log_loss", "roc_auc", "average_precision"]
_SEL = ", ".join(f'round("{c}", 6) AS "{c}"' for c in _COLS)
_BUNDLE = f"z AS (SELECT *, {RATES} FROM cc)"


def _bundle(df: DataFrame, *keep: str) -> DataFrame:
    return rounded(df.select(*keep, "n", *_COLS))


@query(f"WITH {CALLS}, {_metric_sql('ok', 'actual', 'probability_yes', '50', 'model')}, {_BUNDLE} SELECT model, n, {_SEL} FROM z JOIN rk USING (model)")
def q_metrics(spark, d):
    return _bundle(metrics.binary_metrics(answered(spark, d), "actual", "probability_yes", 50, by=["model"]), "model")


@query(f"WITH {PROF}, t AS (SELECT *, 1 AS one FROM sc WHERE split = 'test' AND survey_weight > 0), {_metric_sql('t', 'vaccinated', 'p', '50', 'one', 'survey_weight')}, {_BUNDLE} SELECT n, {_SEL} FROM z JOIN rk USING (one)")
def q_metrics_weighted(spark, d):
    t = anchored(spark, d).filter("split = 'test'")
    return _bundle(metrics.binary_metrics(t, "vaccinated", "anchor_probability", 50, weight="survey_weight"))


@query(f"""WITH {CALLS}, j AS (SELECT ok.*, s0.hbm8_pattern AS raw FROM ok JOIN (SELECT * FROM hbm_scores WHERE source_row_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY scored_at DESC NULLS LAST) = 1) s0 USING (source_row_index)),
    k AS (SELECT *, regexp_replace(lower(raw), '[^a-z]+', '', 'g') AS pattern FROM j WHERE raw IS NOT NULL AND regexp_replace(lower(raw), '[^a-z]+', '', 'g') <> ''),
    {_metric_sql('k', 'actual', 'probability_yes', '50', 'pattern')}, {_BUNDLE} SELECT pattern, n, {_SEL} FROM z JOIN rk USING (pattern)""")
def q_metrics_by_pattern(spark, d):
    s = current_rows(table(spark, d, "hbm_scores").select("source_row_index", "hbm8_pattern", "scored_at"), "source_row_index", F.col("scored_at").desc_nulls_last())
    s = s.select("source_row_index", F.regexp_replace(F.lower("hbm8_pattern"), "[^a-z]+", "").alias("pattern")).filter("pattern <> ''")
    return _bundle(metrics.binary_metrics(answered(spark, d).join(s, "source_row_index"), "actual", "probability_yes", 50, by=["pattern"]), "pattern")


def _sweep_sql(low: int, high: int) -> str:
    return f"""{CALLS}, g AS (SELECT model, t, count(*) FILTER (probability_yes >= t AND actual = 1)::DOUBLE AS tp, count(*) FILTER (probability_yes >= t AND actual = 0)::DOUBLE AS fp,
    count(*) FILTER (probability_yes < t AND actual = 1)::DOUBLE AS fn, count(*) FILTER (probability_yes < t AND actual = 0)::DOUBLE AS tn FROM ok, range({low}, {high + 1}) x(t) GROUP BY model, t), z AS (SELECT *, {RATES} FROM g)"""


@query(f"""WITH {_sweep_sql(1, 99)} SELECT model, CAST(t AS INT) AS threshold, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(f1, 6) AS f1 FROM z""")
def q_sweep(spark, d):
    return rounded(metrics.sweep(answered(spark, d), "actual", "probability_yes", 1, 99, by=["model"]).select("model", "threshold", "accuracy", "balanced_accuracy", "f1"))


@query(f"""WITH {_sweep_sql(1, 99)}, b AS (SELECT *, max(balanced_accuracy) OVER (PARTITION BY model) AS top FROM z),
    best AS (SELECT model, t, balanced_accuracy AS v FROM b WHERE abs(balanced_accuracy - top) <= 1e-8 + 1e-5 * abs(top) QUALIFY row_number() OVER (PARTITION BY model ORDER BY abs(t - 50), t) = 1),
    few AS (SELECT model, count(*) < 10 OR min(actual) = max(actual) AS few FROM ok GROUP BY model)
    SELECT model, CASE WHEN few THEN 50 ELSE CAST(t AS INT) END AS threshold, CASE WHEN NOT few THEN round(v, 6) END AS metric_value FROM best JOIN few USING (model)""")
def q_threshold_a(spark, d):
    return rounded(metrics.best_threshold(answered(spark, d), "actual", "probability_yes", "a", by=["model"]))


@query(f"""WITH {_sweep_sql(5, 95)} SELECT model, CAST(t AS INT) AS threshold, round(f1, 6) AS metric_value FROM z QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(f1, 12) DESC, t) = 1""")
def q_threshold_b(spark, d):
    return rounded(metrics.best_threshold(answered(spark, d), "actual", "probability_yes", "b", "f1", by=["model"]))


@query(f"""WITH {_sweep_sql(5, 95)} SELECT model, CAST(t AS INT) AS threshold, round(accuracy, 6) AS metric_value FROM z QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(accuracy, 12) DESC, t) = 1""")
def q_threshold_c(spark, d):
    return rounded(metrics.best_threshold(answered(spark, d), "actual", "probability_yes", "c", "accuracy", by=["model"]))


@query(f"""WITH {PROF}, c AS (SELECT vaccinated AS y, p / 100 AS p, (motivation_score - 2.5) / 25 AS c FROM sc WHERE split = 'calibration'), g AS (SELECT i * 0.05e0 AS alpha, y, least(greatest(p + i * 0.05e0 * coalesce(c, 0), 0.01e0), 0.99e0) AS q FROM c, range(0, 31) x(i)),
    l AS (SELECT round(alpha, 10) AS alpha, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss, avg(pow(q - y, 2)) AS brier FROM g GROUP BY 1)
    SELECT alpha, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, CAST(row_number() OVER (ORDER BY round(log_loss, 12), round(brier, 12), alpha) AS INT) AS rank FROM l""")
def q_scale_search(spark, d):
    c = anchored(spark, d).filter("split = 'calibration'").select("vaccinated", (F.col("anchor_probability") / 100).alias("p"), ((F.col("motivation_score") - 2.5) / 25).alias("c"))
    return rounded(metrics.scale_search(c, "vaccinated", "p", "c"))


@query(f"""WITH {PROF}, cal AS (SELECT vaccinated AS y, p FROM sc WHERE split = 'calibration'), sw AS (SELECT t, avg((p >= t)::INT) FILTER (y = 1) AS tpr, avg((p < t)::INT) FILTER (y = 0) AS tnr FROM cal, range(1, 100) x(t) GROUP BY t),
    b AS (SELECT t, (tpr + tnr) / 2 AS v, max((tpr + tnr) / 2) OVER () AS top FROM sw), best AS (SELECT t FROM b WHERE abs(v - top) <= 1e-8 + 1e-5 * abs(top) ORDER BY abs(t - 50), t LIMIT 1),
    test AS (SELECT sc.*, best.t AS th, 1 AS one FROM sc, best WHERE split = 'test'), {_metric_sql('test', 'vaccinated', 'p', 'th', 'one')}, {_BUNDLE}
    SELECT (SELECT CAST(t AS DOUBLE) FROM best) AS threshold, n, {_SEL} FROM z JOIN rk USING (one)""")
def q_flagship(spark, d):
    """Codes and scores to patterns, rates and anchors; threshold on calibration, metrics on test."""
    a = anchored(spark, d)
    best = metrics.best_threshold(a.filter("split = 'calibration'"), "vaccinated", "anchor_probability", "a").select(F.col("threshold").cast("double").alias("th"))
    test = a.filter("split = 'test'").join(F.broadcast(best))  # one row
    return _bundle(metrics.binary_metrics(test, "vaccinated", "anchor_probability", F.col("th")), "threshold")


# Logs


@query("""SELECT config_hash, source_row_index, count(*) AS n, max_by(call_id, (created_at, call_id)) AS last_call FROM
    (SELECT * FROM call_log WHERE call_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ingested_at DESC NULLS LAST) = 1)
    WHERE source_row_index IS NOT NULL AND created_at IS NOT NULL GROUP BY ALL""")
def q_latest_calls(spark, d):
    c = calls(spark, d).filter("source_row_index is not null and created_at is not null")
    return c.groupBy("config_hash", "source_row_index").agg(F.count("*").alias("n"), F.max_by("call_id", F.struct("created_at", "call_id")).alias("last_call"))


@query(f"""WITH {CUR}, {CALLS} SELECT source_row_index FROM r WHERE source_row_index NOT IN (SELECT source_row_index FROM c WHERE status = 'ok' AND variant = 'v5' AND source_row_index IS NOT NULL)""")
def q_pending(spark, d):
    done = calls(spark, d).filter("status = 'ok' and variant = 'v5'").select("source_row_index")
    return respondents(spark, d).select("source_row_index").join(done, "source_row_index", "left_anti")


@query("""SELECT model, phase, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_error, round(avg((status = 'ok')::INT), 6) AS success_rate,
    CAST(sum(coalesce(attempt_count, 1)) AS BIGINT) AS attempts, CAST(sum(coalesce(usage.input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(usage.output_tokens, 0)) AS BIGINT) AS output_tokens,
    CAST(sum(coalesce(usage.total_tokens, 0)) AS BIGINT) AS total_tokens FROM call_log GROUP BY ALL""")
def q_diagnostics(spark, d):
    return rounded(stats.phase_diagnostics(table(spark, d, "call_log"), ["model", "phase"]))


@query("SELECT model, failure_category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model), 6) AS share FROM call_log WHERE failure_category IS NOT NULL GROUP BY model, failure_category")
def q_failures(spark, d):
    return rounded(stats.histogram(table(spark, d, "call_log"), ["model"], "failure_category"))


@query("""SELECT k.config_hash, k.model, k.temperature, count(c.call_id) AS n FROM run_configs k LEFT JOIN call_log c ON c.config_hash = k.config_hash AND c.status = 'error' GROUP BY ALL""")
def q_runs_with_errors(spark, d):
    e = table(spark, d, "call_log").filter("status = 'error'").groupBy("config_hash").agg(F.count("call_id").alias("n"))
    k = table(spark, d, "run_configs").select("config_hash", "model", "temperature")
    return k.join(e, "config_hash", "left").fillna(0, ["n"])


# Text


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 119), ' ') || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS t FROM documents)""")
def q_clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text"), 120).alias("snippet"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+'))) AS n_tokens FROM documents""")
def q_token_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.token_set(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).alias("n_tokens"))


@query("""SELECT variant, model, count(*) AS n FROM (SELECT variant, regexp_replace(regexp_replace(lower(trim(model)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS model FROM memory_items) GROUP BY ALL""")
def q_model_slugs(spark, d):
    return table(spark, d, "memory_items").select("variant", X.slug(F.col("model")).alias("model")).groupBy("variant", "model").agg(F.count("*").alias("n"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_items").filter("memory_id is not null").dropDuplicates(["memory_id"])
    return m.select(
        F.col("memory_id").alias("id"), F.col("hbm8_pattern").alias("pattern"), "correction_direction", "source_row_index",
        X.token_set(F.col("correction_rule"), F.concat_ws(" ", "supporting_variables")).alias("tokens"),
        memory.base_value(F.lit(0.5), F.least(F.size("supporting_variables") / 4, F.lit(1.0)), F.coalesce("reflection_confidence", F.lit(0.0)), F.coalesce("estimated_memory_value", F.lit(0.0))).alias("base_value"),
    )


@query()
def q_unique_rules(spark, d):
    return memory.greedy_unique(_rules(spark, d), "id", ["correction_direction"], "base_value", 0.7)


# Errors and candidates


@query(f"""WITH {CALLS}, w AS (SELECT *, CASE WHEN actual = 1 THEN 'increase' ELSE 'decrease' END AS correction_direction,
    least(greatest(CASE WHEN actual = 1 THEN (50 - probability_yes) / 50 ELSE (probability_yes - 50) / 50 END, 0), 1) AS error_confidence FROM ok
    WHERE (actual = 1 AND probability_yes <= 30) OR (actual = 0 AND probability_yes >= 70)), b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY model, correction_direction ORDER BY error_confidence DESC, call_id) <= 6)
    SELECT call_id, model, correction_direction, round(error_confidence, 6) AS error_confidence FROM b ORDER BY b.error_confidence DESC, call_id LIMIT 64""")
def q_confident_errors(spark, d):
    e = memory.confident_errors(answered(spark, d), "actual", "probability_yes", "model", "call_id")
    return rounded(e.select("call_id", "model", "correction_direction", "error_confidence"))


@query(f"""WITH {CALLS} SELECT call_id, round(least(greatest(CASE WHEN actual = 1 THEN (50 - probability_yes) / 50 ELSE (probability_yes - 50) / 50 END, 0), 1), 6) AS error_confidence FROM ok
    WHERE ((actual = 1 AND probability_yes < 50) OR (actual = 0 AND probability_yes >= 50)) AND least(greatest(CASE WHEN actual = 1 THEN (50 - probability_yes) / 50 ELSE (probability_yes - 50) / 50 END, 0), 1) >= 0.2e0
    ORDER BY least(greatest(CASE WHEN actual = 1 THEN (50 - probability_yes) / 50 ELSE (probability_yes - 50) / 50 END, 0), 1) DESC, call_id LIMIT 600""")
def q_wrong_rows(spark, d):
    return rounded(memory.wrong_rows(answered(spark, d), "actual", "probability_yes", "call_id").select("call_id", "error_confidence"))


@query(f"""WITH {CALLS} SELECT model, count(*) AS n, round(avg(actual), 6) AS rate, round(avg(probability_yes / 100), 6) AS mean_p, round(avg(actual - probability_yes / 100), 6) AS mean_error,
    round(avg((actual = 0 AND probability_yes >= 50)::INT), 6) AS fp_share, round(avg((actual = 1 AND probability_yes < 50)::INT), 6) AS fn_share,
    round(avg(probability_yes), 6) AS probability_yes_all, round(avg(probability_yes) FILTER (actual = 0 AND probability_yes >= 50), 6) AS probability_yes_fp,
    round(avg(probability_yes) FILTER (actual = 1 AND probability_yes < 50), 6) AS probability_yes_fn FROM ok GROUP BY model""")
def q_error_profile(spark, d):
    return rounded(stats.error_profile(answered(spark, d), "model", "actual", "probability_yes", ["probability_yes"]))


@query()
def q_ablation(spark, d):
    """The pattern anchor, the overall rate and a raw score against each other: threshold on calibration, metrics on test."""
    a = anchored(spark, d)
    overall = a.filter("split = 'memory'").agg((100 * F.avg("vaccinated")).alias("overall"))
    a = a.join(F.broadcast(overall)).withColumn("motivation", F.col("motivation_score") * 20)  # one row
    cal, test = a.filter("split = 'calibration'"), a.filter("split = 'test'")
    return metrics.ablation(cal, test, "vaccinated", {"pattern_anchor": "anchor_probability", "overall_rate": "overall", "motivation_only": "motivation"}, weight="survey_weight")


# Vectors: queries are the rows whose id is divisible by 20


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("pattern"))
    return e.filter(F.col("id") % 20 == 0), e


_SIM = "list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[])"


@query(f"""SELECT q.vec_id AS id, s.vec_id AS source_id, round(round({_SIM}, 9), 6) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_SIM}, 9) DESC, s.vec_id) AS INT) AS rank
    FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id QUALIFY rank <= 10""")
def q_cosine_topk(spark, d):
    return rounded(retrieval.top_similar(*_vectors(spark, d), [("embedding", 1.0, False)], 10))


@query(f"""SELECT q.vec_id AS id, s.vec_id AS source_id, CAST(s.label AS VARCHAR) AS pattern, round(round({_SIM}, 9), 6) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id, s.label ORDER BY round({_SIM}, 9) DESC, s.vec_id) AS INT) AS rank
    FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id QUALIFY rank <= 4""")
def q_class_knn(spark, d):
    return rounded(retrieval.top_similar(*_vectors(spark, d), [("embedding", 1.0, False)], 4, by="pattern")).select("id", "source_id", "pattern", "similarity", "rank")


@query(f"""WITH x AS (SELECT q.vec_id AS id, s.vec_id AS source_id, least(greatest(0.9e0 * ({_SIM} + 1) / 2 + 0.1e0 * (q.label = s.label)::INT, 0), 1) AS v FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id)
    SELECT id, source_id, round(round(v, 9), 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, source_id) AS INT) AS rank FROM x WHERE round(v, 9) >= 0.45 QUALIFY rank <= 5""")
def q_composite_topk(spark, d):
    return rounded(retrieval.top_similar(*_vectors(spark, d), [("embedding", 0.9, True)], 5, least=0.45, same_pattern=0.1))


@query(f"""WITH x AS (SELECT q.vec_id AS id, s.vec_id AS source_id, s.label % 2 AS dir, round({_SIM}, 9) AS v FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id),
    t AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, source_id) <= 20), y AS (SELECT *, row_number() OVER (PARTITION BY id, dir ORDER BY v DESC, source_id) AS k FROM t)
    SELECT id, source_id, round(round(v, 9), 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY (k > 1)::INT, v DESC, source_id) AS INT) AS pick FROM y QUALIFY pick <= 3""")
def q_diverse_topk(spark, d):
    q, s = _vectors(spark, d)
    t = retrieval.top_similar(q, s, [("embedding", 1.0, False)], 20)
    t = t.join(s.select(F.col("id").alias("source_id"), (F.col("pattern").cast("int") % 2).alias("correction_direction")), "source_id")
    return rounded(retrieval.diverse(t, "similarity", 3).select("id", "source_id", "similarity", "pick"))


@query(f"""WITH n AS (SELECT m.vec_id AS id, s.vec_id AS source_id, m.label AS ml, s.label AS sl, round({_SIM.replace('q.', 'm.')}, 9) AS v FROM embeddings m, embeddings s WHERE m.vec_id % 20 = 0 AND m.vec_id <> s.vec_id
        QUALIFY row_number() OVER (PARTITION BY m.vec_id ORDER BY v DESC, s.vec_id) <= 20),
    p AS (SELECT *, (sl % 2) AS y, 30e0 + 4 * sl AS p0 FROM n WHERE v >= 0.05), p2 AS (SELECT *, least(greatest(p0 + CASE WHEN ml % 2 = 0 THEN 1 ELSE -1 END * 10 * v, 0), 100) AS p1 FROM p),
    e AS (SELECT id, v * v AS w, -(y * ln(p0 / 100) + (1 - y) * ln(1 - p0 / 100)) + (y * ln(p1 / 100) + (1 - y) * ln(1 - p1 / 100)) AS r FROM p2),
    a AS (SELECT id, count(*) AS n, sum(r * w) / sum(w) AS m, avg((r > 0)::INT) AS pos, avg((r < 0)::INT) AS harm FROM e GROUP BY id)
    SELECT vec_id AS id, coalesce(n, 0) AS support_n, coalesce(round(m, 6), 0) AS reward_mean, coalesce(round(n / (n + 20) * m, 6), 0) AS q_value, coalesce(round(pos, 6), 0) AS positive_rate, coalesce(round(harm, 6), 0) AS harmful_rate
    FROM embeddings LEFT JOIN a ON vec_id = id WHERE vec_id % 20 = 0""")
def q_value_memories(spark, d):
    q, s = _vectors(spark, d)
    near = retrieval.top_similar(q, s, [("embedding", 1.0, False)], 20, least=0.05)
    mem = q.select("id", F.when(F.col("pattern").cast("int") % 2 == 0, "increase").otherwise("decrease").alias("correction_direction"))
    out = s.select("id", (F.col("pattern").cast("int") % 2).alias("y"), (30.0 + 4 * F.col("pattern").cast("int")).alias("p"))
    return rounded(retrieval.value_memories(near, mem, out))


@query(f"""WITH n AS (SELECT q.vec_id AS id, s.label AS sl, round({_SIM}, 9) AS v FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY v DESC, s.vec_id) <= 5)
    SELECT id, round(least(greatest(sum(pow(greatest(v, 0), 2) * greatest(sl / 10e0, 0.05e0) * (sl - 4.5e0) / 10) / sum(pow(greatest(v, 0), 2) * greatest(sl / 10e0, 0.05e0)) * count(*) / (count(*) + 2), -0.25e0), 0.25e0), 6) AS correction FROM n GROUP BY id""")
def q_empirical_correction(spark, d):
    q, s = _vectors(spark, d)
    near = retrieval.top_similar(q, s, [("embedding", 1.0, False)], 5)
    lab = s.select(F.col("id").alias("source_id"), (F.col("pattern").cast("int") / 10).alias("confidence"), ((F.col("pattern").cast("int") - 4.5) / 10).alias("residual"))
    return rounded(retrieval.empirical_correction(near.join(lab, "source_id")))


@query("""WITH a AS (SELECT *, avg(p_size) OVER () AS ms, stddev_pop(p_size) OVER () AS ss, avg(p_retailprice) OVER () AS mp, stddev_pop(p_retailprice) OVER () AS sp FROM part)
    SELECT p_partkey, round((p_size - ms) / ss, 6) AS x0, round((p_retailprice - mp) / sp, 6) AS x1, CAST((SELECT count(DISTINCT p_brand) FROM part) + 2 AS INT) AS width FROM a""")
def q_features(spark, d):
    p = table(spark, d, "part")
    f = retrieval.fit_features(p, p, ["p_size", "p_retailprice"], ["p_brand"])
    return rounded(f.select("p_partkey", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), F.size("x").alias("width")))


_NEAR = f"""n AS (SELECT q.vec_id AS id, s.vec_id AS source_id, q.label AS ql, s.label AS sl, round({_SIM}, 9) AS v FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0 AND q.vec_id <> s.vec_id
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY v DESC, s.vec_id) <= 20)"""


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Twenty neighbours of every query and memories made of all vectors."""
    q, s = _vectors(spark, d)
    n = F.col("pattern").cast("int")
    m = s.select("id", "pattern", (n / 10).alias("memory_value"), (n / 10).alias("memory_strength"), (n % 3).alias("correction_direction"), ((n - 4) / 100).alias("q_value"))
    return retrieval.top_similar(q, s, [("embedding", 1.0, False)], 20), m, q


@query(f"""WITH {_NEAR} SELECT id, source_id, CAST(row_number() OVER (PARTITION BY id ORDER BY v DESC, sl DESC, source_id) AS INT) AS pick FROM n WHERE v >= 0.1 QUALIFY pick <= 2""")
def q_retrieve_by_similarity(spark, d):
    near, m, _ = _near(spark, d)
    return retrieval.retrieve_v4(near, m, least=0.1).select("id", "source_id", "pick")


@query(f"""WITH {_NEAR}, k AS (SELECT *, round(0.7e0 * v + 0.3e0 * (sl / 10e0), 12) AS score, sl % 3 AS dir FROM n WHERE v >= 0.1), o AS (SELECT *, row_number() OVER (PARTITION BY id, dir ORDER BY score DESC, source_id) AS r FROM k)
    SELECT id, source_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY (r > 1)::INT, score DESC, source_id) AS INT) AS pick FROM o QUALIFY pick <= 3""")
def q_retrieve_diverse(spark, d):
    near, m, _ = _near(spark, d)
    return rounded(retrieval.retrieve_v5(near, m, least=0.1).select("id", "source_id", "score", "pick"))


@query(f"""WITH {_NEAR}, k AS (SELECT *, 0.6e0 * v + 0.2e0 * (0.5e0 + 0.5e0 * tanh((sl - 4) / 100e0 / 0.02e0)) + 0.1e0 * (sl / 10e0) + 0.1e0 * (ql = sl)::INT AS score, sl % 3 AS dir FROM n WHERE v >= 0.1 AND (sl - 4) / 100e0 >= -0.002e0),
    o AS (SELECT *, row_number() OVER (PARTITION BY id, dir ORDER BY score DESC, source_id) AS r FROM k)
    SELECT id, source_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY (r > 1)::INT, score DESC, source_id) AS INT) AS pick FROM o QUALIFY pick <= 3""")
def q_retrieve_valued(spark, d):
    near, m, q = _near(spark, d)
    return rounded(retrieval.retrieve_valued(near, m, q, least=0.1).select("id", "source_id", "score", "pick"))


@query(f"""WITH {_NEAR}, k AS (SELECT *, 0.85e0 * v + 0.15e0 * least(1, sl / 10e0) AS score FROM n WHERE v >= 0.1)
    SELECT id, source_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, source_id) AS INT) AS pick FROM k QUALIFY pick <= 5""")
def q_retrieve_residual(spark, d):
    near, m, _ = _near(spark, d)
    return rounded(retrieval.retrieve_residual(near, m, least=0.1).select("id", "source_id", "score", "pick"))


# Validators, repairs, samples


@query(f"""WITH {CALLS}, k AS (SELECT call_id, probability_yes AS p, least(greatest(raw_prediction * 60e0 - 30, -30), 30) AS a FROM ok WHERE raw_prediction IS NOT NULL)
    SELECT call_id, a AS residual_adjustment, round(least(greatest(p + a, 0), 100), 6) AS probability_yes, abs(p - least(greatest(p + a, 0), 100)) > 1 AS probability_consistency_corrected,
    CASE WHEN a > 2 THEN 'higher_than_pattern' WHEN a < -2 THEN 'lower_than_pattern' ELSE 'similar_to_pattern' END AS deviation_direction FROM k""")
def q_validate_decisions(spark, d):
    c = current_rows(table(spark, d, "call_log").select("call_id", "ingested_at", "status", "actual", "probability_yes", "raw_prediction"), "call_id", F.col("ingested_at").desc_nulls_last())
    c = c.filter((F.col("status") == "ok") & F.col("actual").isin(0, 1) & F.col("probability_yes").isNotNull() & ~F.isnan("probability_yes") & F.col("raw_prediction").isNotNull())
    v = predictor.decision(F.col("probability_yes"), F.col("raw_prediction") * 60.0 - 30, F.col("probability_yes"), F.lit(""))
    return rounded(c.select("call_id", v.alias("v")).select("call_id", "v.residual_adjustment", "v.probability_yes", "v.probability_consistency_corrected", "v.deviation_direction"))


#: Answers of free-text models, as a table of (id, direction, strength, confidence).
SPELLED = (
    (1, "Upwards", "Mild", "high"), (2, " no-change ", "mid", "Very High"), (3, "LOWER", "large", "85%"), (4, "sideways", "none", "0.5%"), (5, None, None, None),
    (6, "reduce", "strong", "140"), (7, "No", "weak", "-3"), (8, "Positive", "High", "nan"), (9, "up ward", "odd one", "moderate"), (10, "", "", "about half"),
)
SPELLED_SQL = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in SPELLED)


@query(f"""WITH t AS (SELECT id, replace(replace(lower(trim(coalesce(d, ''))), '-', '_'), ' ', '_') AS d, replace(replace(lower(trim(coalesce(s, ''))), '-', '_'), ' ', '_') AS s, lower(trim(c)) AS c,
        CASE WHEN isnan(TRY_CAST(replace(c, '%', '') AS DOUBLE)) THEN NULL ELSE TRY_CAST(replace(c, '%', '') AS DOUBLE) END AS x FROM (VALUES {SPELLED_SQL}) v(id, d, s, c)),
    m AS (SELECT memory_id + 100 AS id, correction_direction AS d, '' AS s, NULL AS c, reflection_confidence AS x FROM memory_items WHERE memory_id IS NOT NULL GROUP BY ALL)
    SELECT CAST(id AS BIGINT) AS id, CASE WHEN d IN ('increase', 'up', 'upward', 'higher', 'positive', 'raise', 'upwards') THEN 'increase' WHEN d IN ('decrease', 'down', 'downward', 'lower', 'negative', 'reduce', 'downwards') THEN 'decrease'
        WHEN d IN ('none', 'no', 'neutral', 'no_change', 'unchanged') THEN 'none' ELSE d END AS direction,
    CASE WHEN s IN ('low', 'small', 'mild') THEN 'weak' WHEN s IN ('medium', 'mid') THEN 'moderate' WHEN s IN ('high', 'large') THEN 'strong' WHEN s IN ('none', 'no') THEN 'none' ELSE s END AS strength,
    round(CASE c WHEN 'very low' THEN 0.2e0 WHEN 'low' THEN 0.35e0 WHEN 'medium' THEN 0.6e0 WHEN 'moderate' THEN 0.6e0 WHEN 'high' THEN 0.8e0 WHEN 'very high' THEN 0.9e0
        ELSE CASE WHEN x IS NULL THEN 0.5e0 WHEN x <= 0 THEN 0e0 WHEN x > 1 AND x <= 100 THEN x / 100 WHEN x > 100 THEN 1e0 ELSE x END END, 6) AS confidence FROM (FROM t UNION ALL FROM m)""")
def q_normalise_rules(spark, d):
    m = table(spark, d, "memory_items").filter("memory_id is not null")
    m = m.select((F.col("memory_id") + 100).alias("id"), F.col("correction_direction").alias("d"), F.lit("").alias("s"), F.col("reflection_confidence").cast("string").alias("c")).distinct()
    spelled = spark.createDataFrame([tuple(r) for r in SPELLED], "id long, d string, s string, c string").unionByName(m)
    return rounded(spelled.select("id", X.alias(F.col("d"), X.DIRECTIONS, keep=True).alias("direction"), X.alias(F.col("s"), X.STRENGTHS, keep=True).alias("strength"), X.confidence(F.col("c")).alias("confidence")))


@query(f"""WITH {PROF}, g AS (SELECT median(survey_weight) AS m FROM s WHERE survey_weight > 0), f AS (SELECT source_row_index, CASE WHEN survey_weight > 0 THEN survey_weight ELSE m END AS w FROM s, g)
    SELECT source_row_index, round(w / avg(w) OVER (), 6) AS fit_weight FROM f""")
def q_repair_weights(spark, d):
    return rounded(stats.repair_weights(split_scores(spark, d), "survey_weight").select("source_row_index", "fit_weight"))


@query(f"""WITH {PROF} SELECT source_row_index, CAST(vaccinated AS INT) AS label FROM sp WHERE split = 'memory' AND r0 < 4""")
def q_balanced_support(spark, d):
    m = split_scores(spark, d).filter("split = 'memory'")
    ranked = splits.dense_order(m, ["vaccinated"], "source_row_index")
    return ranked.filter("rank0 < 4").select("source_row_index", F.col("vaccinated").cast("int").alias("label"))


@query(f"""WITH {PROF}, t AS (SELECT *, CASE WHEN vaccinated - p / 100 >= 0 THEN 'increase' ELSE 'decrease' END AS residual_direction, abs(vaccinated - p / 100) AS a FROM sc WHERE split = 'memory'),
    e AS (SELECT * FROM t WHERE a >= 0.4 OR NOT (SELECT bool_or(a >= 0.4) FROM t)), k AS (SELECT count(*) AS k FROM (SELECT DISTINCT residual_direction, pattern FROM e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY residual_direction, pattern ORDER BY round(a, 9) DESC, source_row_index) AS rn FROM e)
    SELECT source_row_index, pattern AS hbm8_pattern, residual_direction, round(a, 6) AS abs_residual FROM r, k ORDER BY (rn <= greatest(1, ceil(100e0 / k))) DESC, round(a, 9) DESC, source_row_index LIMIT 100""")
def q_residual_top(spark, d):
    a = anchored(spark, d).filter("split = 'memory'").withColumn("r", F.round(F.col("vaccinated") - F.col("anchor_probability") / 100, 9))
    return rounded(memory.residual_candidates(a, "r", "hbm8_pattern", "source_row_index", total=100).select("source_row_index", "hbm8_pattern", "residual_direction", "abs_residual"))


@query(f"""WITH {PROF} SELECT source_row_index, round(-(vaccinated * ln(least(greatest(p / 100, 1e-6), 1 - 1e-6)) + (1 - vaccinated) * ln(1 - least(greatest(p / 100, 1e-6), 1 - 1e-6))), 6) AS loss,
    round(ln(p / 100 / (1 - p / 100)), 6) AS logit FROM sc""")
def q_row_losses(spark, d):
    p = F.col("anchor_probability") / 100
    return rounded(anchored(spark, d).select("source_row_index", R.log_loss(F.col("vaccinated"), p).alias("loss"), R.logit(p).alias("logit")))


@query("""SELECT call_id, CASE WHEN t LIKE '%ratelimit%' OR m LIKE '%429%' OR m LIKE '%rate limit%' THEN 'api_rate_limit' WHEN t LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'api_timeout'
    WHEN t LIKE '%connect%' OR m LIKE '%connection%' THEN 'api_connection' WHEN t LIKE '%authentication%' OR m LIKE '%401%' THEN 'api_authentication'
    WHEN t LIKE '%permission%' OR m LIKE '%403%' THEN 'api_permission' WHEN t <> '' OR m <> '' THEN 'api_other' END AS category
    FROM (SELECT call_id, coalesce(lower(error_type), '') AS t, replace(coalesce(lower(error_message), ''), '_', ' ') AS m FROM call_log WHERE status = 'error') GROUP BY ALL""")
def q_failure_category(spark, d):
    # The log names categories with underscores where messages of services have spaces.
    c = table(spark, d, "call_log").filter("status = 'error'")
    return c.select("call_id", predictor.failure_category(F.replace(F.col("error_message"), F.lit("_"), F.lit(" ")), F.col("error_type")).alias("category")).distinct()


# Joins, unions, pivots on the star schema


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def q_semi_join(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F'""")
def q_set_difference(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "F"))
    return table(spark, d, "customer").select("c_custkey").subtract(o.select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT c_mktsegment, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS "F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS "O", round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS "P"
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def q_pivot(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    j = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rounded(stats.pivot_metrics(j, ["c_mktsegment"], "o_orderstatus", ["F", "O", "P"], ["o_totalprice"]))


@query("""SELECT 'customer' AS kind, c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance, CAST(NULL AS VARCHAR) AS note FROM customer UNION ALL SELECT 'supplier', s_name, CAST(s_acctbal AS VARCHAR), NULL FROM supplier""")
def q_union_aligned(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("string").alias("balance"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("string").alias("balance"))
    return stats.union_aligned([c, s], ["kind", "name", "balance", "note"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q_line_summary(spark, d):
    l = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount")
    )


@query("""SELECT CAST(l_returnflag = 'R' AS INT) AS y, count(*) AS n, round(avg(CASE WHEN l_linenumber <> 3 THEN l_discount END), 6) AS mean_known FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' GROUP BY 1""")
def q_line_orders(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_discount").join(o, "l_orderkey")
    return rounded(l.groupBy((F.col("l_returnflag") == "R").cast("int").alias("y")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("l_linenumber") != 3, F.col("l_discount"))).alias("mean_known")))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type""")
def q_event_props(spark, d):
    e = table(spark, d, "events")
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.avg("value").alias("mean_value")))


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_latest_events(spark, d):
    return current_rows(table(spark, d, "events"), "user_id", F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")
