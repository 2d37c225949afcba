"""Construct scores in one projection: five proxies, three meta scores, evidence.

Every proxy is 5 times the weighted mean over the available components, limited to 0 to 5. The
weights and code maps are fixed values of the score definition. All expressions stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.recode import (
    HIGH_MISSING, band, clip, code_map, row_max, row_mean, row_sum, strength, valid, weighted_available, yes_no,
)

#: Column groups of the survey.
CHRONIC = "hypev_a chdev_a angev_a miev_a strev_a astill_a canev_a dibev_a copdev_a kidweakev_a liverev_a".split()
OTHER_VACCINES = "shtcvd191_a shtcvd19nm2_a shtpnuev_a shtshingl1_a shingrix3_a shthepa_a".split()
PROXIES = {
    "v4": ["observed_threat_proxy", "vaccine_acceptance_benefit_proxy", "structural_barrier_proxy", "healthcare_cue_proxy", "navigation_self_efficacy_proxy"],
    "v5": ["observed_threat_proxy", "preventive_engagement_proxy", "structural_barrier_proxy", "healthcare_cue_proxy", "navigation_self_efficacy_proxy"],
}
#: Default component weights; a config may replace them section by section.
WEIGHTS = {
    "v4": {
        "threat": {"age": 0.25, "health": 0.20, "chronic": 0.35, "function": 0.10, "immune": 0.10},
        "second": {"covid": 0.50, "pneumonia": 0.25, "shingles": 0.25},
        "barrier": {"insurance": 0.25, "cost": 0.35, "financial": 0.20, "transport": 0.10, "communication": 0.10},
        "cue": {"doctor": 0.35, "wellness": 0.35, "retail_virtual": 0.15, "acute": 0.15},
        "navigation": {"usual": 0.30, "setting": 0.10, "internet": 0.15, "digital": 0.25, "virtual": 0.10, "communication": 0.10},
    },
    "v5": {
        "threat": {"age": 0.25, "health": 0.20, "chronic": 0.35, "function": 0.10, "immune": 0.10},
        "second": {"wellness": 0.45, "look": 0.20, "comm": 0.20, "test": 0.15},
        "barrier": {"insurance": 0.25, "cost": 0.35, "financial": 0.20, "transport": 0.10, "communication": 0.10},
        "cue": {"doctor": 0.45, "retail_virtual": 0.25, "acute": 0.10, "usual": 0.20},
        "navigation": {"usual": 0.35, "setting": 0.15, "internet": 0.20, "virtual": 0.10, "communication": 0.20},
    },
}
#: Observed components for strong and moderate evidence.
EVIDENCE = {
    "v4": {"threat": (4, 3), "second": (3, 2), "barrier": (4, 3), "cue": (4, 3), "navigation": (5, 3)},
    "v5": {"threat": (4, 3), "second": (4, 2), "barrier": (4, 3), "cue": (4, 3), "navigation": (4, 3)},
}
HEALTH = {1: 0.0, 2: 0.15, 3: 0.35, 4: 0.75, 5: 1.0}
WELLNESS_RECENCY = {0: 0.0, 1: 1.0, 2: 0.65, 3: 0.40, 4: 0.20, 5: 0.05, 6: 0.0}
LAST_VISIT = {0: 0.0, 1: 1.0, 2: 0.5, 3: 0.25, 4: 0.1, 5: 0.0, 6: 0.0}
USUAL = {1: 1.0, 2: 0.0, 3: 0.6}
SETTING = {1: 1.0, 2: 0.7, 3: 0.2, 4: 1.0, 5: 0.5, 6: 0.3}
RETAIL = {0: 0.0, 1: 0.5, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}
WORRY = {1: 0.70, 2: 0.35, 3: 0.0}


def _of(col: str, codes: Mapping[int, float]) -> Column:
    return code_map(valid(col, list(codes), bad=()), codes)


def age() -> Column:
    return valid("agep_a", bad=HIGH_MISSING)


def chronic_count() -> Column:
    return row_sum(*[yes_no(c) for c in CHRONIC])


def components(variant: str) -> dict[str, dict[str, Column]]:
    """Component expressions by section."""
    yn, a, n = yes_no, age(), chronic_count()
    retail = _of("retailhc12mtc_a", RETAIL)
    urgent, er = valid("urgcc12mtc_a", (0, 1, 2, 3, 4, 5)), valid("emerg12mtc_a", (0, 1, 2, 3, 4))
    acute = row_max((urgent > 0).cast("double"), (er > 0).cast("double"), yn("hospongt_a"))
    months = clip(valid("hinotmyr_a", bad=HIGH_MISSING), 0, 12) / 12
    wellness = F.coalesce(_of("wellvis_a", WELLNESS_RECENCY), yn("wellness_a"))
    out = {
        "threat": {
            "age": band(a, (50, 65, 75), (0.0, 0.45, 0.75, 1.0)),
            "health": _of("phstat_a", HEALTH),
            "chronic": band(n, (1, 2, 3, 4), (0.0, 0.35, 0.60, 0.80, 1.0)),
            "function": row_max(yn("anydiff_a"), yn("disab3_a")),
            "immune": yn("hlthcond_a"),
        },
        "barrier": {
            "insurance": row_max(
                row_max(1 - yn("hicov_a"), yn("notcov_a")), 0.70 * yn("hinotyr_a"), months, yn("rsnhicost_a"), 0.50 * yn("histopcost_a")
            ),
            "cost": row_max(yn("medng12m_a"), 0.8 * yn("meddl12m_a"), 0.8 * yn("rxdg12m_a"), 0.6 * yn("rxdl12m_a")),
            "financial": row_max(
                yn("paynobllnw_a"), 0.7 * yn("paybll12m_a"), _of("payworry_a", WORRY), 0.2 * yn("prdeduc1_a"), 0.2 * yn("prdeduc2_a")
            ),
            "transport": yn("transpor_a"),
            "communication": _of("comdiff_a", {1: 0.0, 2: 0.33, 3: 0.67, 4: 1.0}),
        },
        "navigation": {
            "usual": _of("usualpl_a", USUAL),
            "setting": _of("usplkind_a", SETTING),
            "internet": row_mean(yn("accssint_a"), yn("accsshom_a")),
            "virtual": yn("virapp12m_a"),
            "communication": _of("comdiff_a", {1: 1.0, 2: 0.67, 3: 0.33, 4: 0.0}),
        },
    }
    if variant == "v4":
        covid, doses = yn("shtcvd191_a"), valid("shtcvd19nm2_a", (1, 2, 3))
        offline = yn("accssint_a") == 0
        item = lambda c: F.when(yn(c).isNull() & offline, 0.0).otherwise(yn(c))
        out["second"] = {
            "covid": F.when(covid == 0, 0.0).when((covid == 1) & doses.isNull(), 0.70).when(covid == 1, code_map(doses, {1: 0.70, 2: 0.85, 3: 1.0})),
            # A missing operand makes a condition false, which leaves the component unknown.
            "pneumonia": F.when((a >= 65) | (n >= 1) | (yn("hlthcond_a") == 1), yn("shtpnuev_a")),
            "shingles": F.when(a >= 50, F.when(yn("shingrix3_a") == 1, 1.0).otherwise(yn("shtshingl1_a"))),
        }
        out["cue"] = {
            "doctor": _of("lastdr_a", LAST_VISIT),
            "wellness": wellness,
            "retail_virtual": row_max(retail, 0.6 * yn("virapp12m_a")),
            "acute": 0.5 * acute,
        }
        out["navigation"]["digital"] = row_mean(item("hitlook_a"), item("hitcomm_a"), item("hittest_a"))
    else:
        out["second"] = {"wellness": wellness, "look": yn("hitlook_a"), "comm": yn("hitcomm_a"), "test": yn("hittest_a")}
        out["cue"] = {
            "doctor": _of("lastdr_a", LAST_VISIT),
            "retail_virtual": row_max(retail, 0.6 * yn("virapp12m_a")),
            "acute": 0.45 * acute,
            "usual": _of("usualpl_a", USUAL),
        }
    return out


def score_table(df: DataFrame, variant: str = "v4", config: Mapping[str, Mapping[str, float]] | None = None, keep: tuple[str, ...] = ("source_row_index",)) -> DataFrame:
    """The score table of a variant. ``config`` overlays weights per section; unknown names raise."""
    if variant == "v5" and (leaks := [c for c in keep if c in OTHER_VACCINES]):
        raise ValueError(f"columns not allowed in this variant: {leaks}")
    weights = {s: dict(w) for s, w in WEIGHTS[variant].items()}
    for section, w in (config or {}).items():
        if section not in weights and section not in ("motivation", "capability"):
            raise ValueError(f"unknown section {section}")
        if section in weights:
            weights[section] |= w
    parts = components(variant)
    names = dict(zip(("threat", "second", "barrier", "cue", "navigation"), PROXIES[variant]))
    cols: dict[str, Column] = {"vaccinated": yes_no("shtflu12m_a"), "survey_weight": F.when(F.col("wtfa_a") > 0, F.col("wtfa_a")), "chronic_or_risk_count": chronic_count()}
    for section, w in weights.items():
        for c in w:
            cols[f"{section}_{c}_component"] = parts[section][c]
    first = df.select(*keep, *[c.alias(k) for k, c in cols.items()], *([yes_no("shthepa_a").alias("__bonus")] if variant == "v4" else []))
    second: dict[str, Column] = {}
    for section, w in weights.items():
        mean, n, coverage = weighted_available({c: (F.col(f"{section}_{c}_component"), v) for c, v in w.items()})
        bonus = F.when(F.col("__bonus") == 1, 0.25).otherwise(0.0) if (variant, section) == ("v4", "second") else F.lit(0.0)
        second[names[section]] = clip(5 * mean + bonus, 0, 5)
        second[f"{section}_evidence_strength"] = strength(n, *EVIDENCE[variant][section])
        second[f"{section}_evidence_coverage"] = coverage
    scored = first.withColumns(second).drop("__bonus")
    p = [F.col(names[s]) for s in ("threat", "second", "barrier", "cue", "navigation")]
    pair = lambda key, x, y: weighted_available(dict(zip("ab", zip((x, y), (list((config or {}).get(key, {}).values()) or [0.5, 0.5])))))[0]
    return scored.withColumns(
        {"motivation_score": pair("motivation", p[0], p[1]), "capability_score": pair("capability", 5 - p[2], p[4]), "activation_score": p[3]}
    )


def contextual_scores(df: DataFrame, keep: tuple[str, ...] = ("source_row_index",)) -> DataFrame:
    """Five context scores in -1 to 1: unweighted means of mapped items, 0 where nothing is known."""
    yn = yes_no
    recency = {0: 0.0, 1: 1.0, 2: 0.65, 3: 0.45, 4: 0.25, 5: 0.10, 6: 0.0}
    visits = {0: 0.0, 1: 0.35, 2: 0.65, 3: 1.0}
    chronic = clip(F.coalesce(chronic_count(), F.lit(0.0)) / 5, 0, 1)
    usual = _of("usualpl_a", {1: 1.0, 2: 0.0, 3: 0.45})
    talk = _of("comdiff_a", {1: 0.0, 2: 0.35, 3: 0.70, 4: 1.0})
    last, well = _of("lastdr_a", recency), _of("wellvis_a", recency)
    lists = {
        "threat": [clip((age() - 18) / 67, 0, 1), _of("phstat_a", {1: 0.0, 2: 0.15, 3: 0.35, 4: 0.70, 5: 1.0}), chronic, yn("anydiff_a"), yn("disab3_a"), yn("hlthcond_a"),
                   _of("bmicat_a", {1: 0.25, 2: 0.0, 3: 0.35, 4: 0.70}), _of("smkcigst_a", {1: 1.0, 2: 0.75, 3: 0.0, 4: 0.35})],
        "preventive": [yn("wellness_a"), well, last, usual, yn("hitlook_a"), yn("hitcomm_a"), yn("hittest_a"), yn("virapp12m_a")],
        "barrier": [1 - yn("hicov_a"), yn("notcov_a"), yn("hinotyr_a"), clip(valid("hinotmyr_a", bad=HIGH_MISSING) / 12, 0, 1),
                    *[yn(c) for c in "rsnhicost_a histopcost_a meddl12m_a medng12m_a rxdl12m_a rxdg12m_a".split()],
                    _of("payworry_a", {1: 0.0, 2: 0.25, 3: 0.50, 4: 0.75, 5: 1.0}), yn("paybll12m_a"), yn("paynobllnw_a"), yn("transpor_a"), talk],
        "cue": [last, yn("wellness_a"), well, _of("retailhc12mtc_a", visits), yn("virapp12m_a"), _of("urgcc12mtc_a", visits), _of("emerg12mtc_a", visits), yn("hospongt_a"), usual],
        "navigation": [usual, _of("usplkind_a", {1: 1.0, 2: 0.55, 3: 0.20, 4: 0.80, 5: 0.45, 6: 0.15}), *[yn(c) for c in "accssint_a accsshom_a hitlook_a hitcomm_a hittest_a".split()], 1 - talk],
    }
    # Items first, then the means: one select of both is too large to compile.
    items = df.select(*keep, *[c.alias(f"{k}_{i}") for k, v in lists.items() for i, c in enumerate(v)])
    mean = lambda k, n: row_mean(*[F.col(f"{k}_{i}") for i in range(n)])
    return items.select(*keep, *[clip(2 * F.coalesce(mean(k, len(v)), F.lit(0.5)) - 1, -1, 1).alias(f"{k}_context") for k, v in lists.items()])


def evidence_text(parts: Mapping[str, Column]) -> Column:
    """``name=value; ...`` with two decimals; missing values are written ``nan``."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.round(c, 2).cast("string"), F.lit("nan"))) for k, c in parts.items()])


def profile_json(df: DataFrame, fields: Mapping[str, list[str]], keep: tuple[str, ...] = ("source_row_index",)) -> DataFrame:
    """Nested profile as JSON text, nulls kept; ``fields``: section to column names."""
    sections = [F.struct(*[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in cs]).alias(s) for s, cs in fields.items()]
    return df.select(*keep, F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("profile"))


def active_conditions(labels: Mapping[str, str]) -> Column:
    """Labels of the conditions that are present."""
    return F.filter(F.array(*[F.when(yes_no(c) == 1, v) for c, v in labels.items()]), lambda x: x.isNotNull())
