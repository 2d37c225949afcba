"""Queries of the general data problems over the survey tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import nested
from tallyloom.operators.impute import Field, filled_table, impute
from tallyloom.sources.tables import current_rows, table

#: The legal codes of the fields to fill.
FILL_FIELDS = (
    Field("ratcat_a", 1, 14),
    Field("phstat_a", 1, 5),
    Field("region", 1, 4, nominal=True),
    Field("structural_barrier_proxy", 0, 5, whole=False, where="has_score"),
)
GROUPS = (("pstrat", "srvy_yr"), ("pstrat",), ("srvy_yr",))


def respondents(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "respondents"), "source_row_index", F.col("loaded_at").desc_nulls_last())


def scores(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "hbm_scores"), "source_row_index", F.col("scored_at").desc_nulls_last())


def _survey(spark: SparkSession, d: str) -> DataFrame:
    mine = ["navigation_self_efficacy_proxy", "healthcare_cue_proxy", "observed_threat_proxy", "structural_barrier_proxy"]
    s = scores(spark, d).select("source_row_index", *mine, F.lit(True).alias("has_score"))
    r = respondents(spark, d).select(
        "source_row_index", "pstrat", "srvy_yr", "agep_a", "sex_a", "educp_a", "ratcat_a", "phstat_a", "region", "bmicat_a",
        "smkcigst_a", "hypev_a", "dibev_a", "anydiff_a", "hicov_a", "medng12m_a", "payworry_a", "lastdr_a", F.lit(True).alias("has_row"),
    )
    return r.join(s, "source_row_index", "full")


def _features() -> dict:
    """Feature name to cleaned column; names equal to a field's are left out for that field."""
    legal = {
        "agep_a": (18, 85), "sex_a": (1, 2), "educp_a": (0, 10), "ratcat_a": (1, 14), "phstat_a": (1, 5), "region": (1, 4),
        "bmicat_a": (1, 4), "smkcigst_a": (1, 4), "hypev_a": (1, 2), "dibev_a": (1, 2), "anydiff_a": (1, 2), "hicov_a": (1, 2),
        "medng12m_a": (1, 2), "payworry_a": (1, 3), "lastdr_a": (0, 6), "navigation_self_efficacy_proxy": (0, 5),
        "healthcare_cue_proxy": (0, 5), "observed_threat_proxy": (0, 5), "structural_barrier_proxy": (0, 5),
    }
    return {n: F.when((F.col(n) >= lo) & (F.col(n) <= hi), F.col(n)) for n, (lo, hi) in legal.items()}


def _fields() -> tuple[Field, ...]:
    return tuple(f if f.where else Field(f.name, f.low, f.high, f.whole, f.nominal, "has_row") for f in FILL_FIELDS)


def fills(spark: SparkSession, d: str) -> DataFrame:
    return impute(_survey(spark, d), "source_row_index", _fields(), _features(), GROUPS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_nodes(table(spark, d, "nested_records"))


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(table(spark, d, "nested_records"))


def _flat(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_tables(table(spark, d, "nested_records"))[name]

    run.__name__ = f"p1_{name}"
    return run


FLAT = tuple(_flat(n) for n in ("constructs", "components", "items", "steps", "evidence"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Per branch and level: nodes, distinct ids, and nodes whose parent is not in the table."""
    nodes = nested.durable(nested.node_table(table(spark, d, "nested_records")).select("branch", "depth", "node_id", "parent_id"))
    ids = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    lost = F.count_if((F.col("depth") > 0) & F.col("known").isNull())
    return nodes.join(ids, "parent_id", "left").groupBy("branch", "depth").agg(
        F.count("*").alias("nodes"), F.countDistinct("node_id").alias("ids"), lost.alias("without_parent")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The missing values that were filled from a donor."""
    return fills(spark, d).filter("was_filled").select("source_row_index", "field_name").distinct()


def p2_fills(spark: SparkSession, d: str) -> DataFrame:
    return fills(spark, d)


def p2_filled_table(spark: SparkSession, d: str) -> DataFrame:
    base = _survey(spark, d)
    keep = ["source_row_index", "pstrat", "srvy_yr", *[f.name for f in FILL_FIELDS]]
    return filled_table(base.select(*keep), "source_row_index", _fields(), fills(spark, d))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per field: missing and filled values, fills that are illegal or differ from their donor's value."""
    base = _survey(spark, d)
    names = [f.name for f in FILL_FIELDS]
    seen = base.select(F.col("source_row_index").alias("donor_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).cast("double").alias("observed")) for n in names])).alias("v")).select("donor_id", "v.*")
    legal = F.lit(False)
    for f in FILL_FIELDS:
        legal = F.when(F.col("field_name") == f.name, f.legal(F.col("filled_value"))).otherwise(legal)
    return fills(spark, d).join(seen, ["donor_id", "field_name"], "left").groupBy("field_name").agg(
        F.count("*").alias("n_missing"), F.count_if("was_filled").alias("n_filled"), F.count_if(~legal).alias("n_illegal"),
        F.count_if(~F.col("filled_value").eqNullSafe(F.col("observed"))).alias("n_not_of_donor"),
    )


def p2_quality(spark: SparkSession, d: str) -> DataFrame:
    """Fills of observed values that were held out (5 % by hash) against these values."""
    base = _survey(spark, d)
    ids, masked, pairs = F.col("source_row_index"), {}, []
    for f in _fields():
        held = f.legal(F.col(f.name).cast("double")) & (F.pmod(F.xxhash64(ids, F.lit(f.name)), F.lit(20)) == 0)
        masked[f.name] = F.when(~held, F.col(f.name))
        pairs.append(F.when(held, F.struct(F.lit(f.name).alias("field_name"), F.col(f.name).cast("double").alias("truth"))))
    truth = base.select("source_row_index", F.explode(F.array(*pairs)).alias("t")).filter("t is not null").select("source_row_index", "t.*")
    got = impute(base.withColumns(masked), "source_row_index", _fields(), _features(), GROUPS)
    means = truth.groupBy("field_name").agg(F.avg("truth").alias("m"))
    both = truth.join(got, ["source_row_index", "field_name"], "left").join(F.broadcast(means), "field_name")  # one row a field
    return both.groupBy("field_name").agg(
        F.count("*").alias("n_held"), F.count("filled_value").alias("n_filled"), F.avg(F.abs(F.col("filled_value") - F.col("truth"))).alias("error"),
        F.avg(F.abs(F.col("m") - F.col("truth"))).alias("error_of_mean"), F.avg((F.col("filled_value") == F.col("truth")).cast("double")).alias("same_share"),
        F.avg("truth").alias("mean_truth"), F.avg("filled_value").alias("mean_filled"), F.stddev_pop("truth").alias("sd_truth"), F.stddev_pop("filled_value").alias("sd_filled"),
    )


QUERIES = {q.__name__: q for q in (p1_found, p1_nodes, *FLAT, p1_links, p2_found, p2_fills, p2_filled_table, p2_summary, p2_quality)}

#: SQL counterparts (DuckDB).
MISSING = """
        WITH r AS (SELECT * FROM respondents WHERE source_row_index IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY loaded_at DESC NULLS LAST) = 1),
        s AS (SELECT * FROM hbm_scores WHERE source_row_index IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY scored_at DESC NULLS LAST) = 1),
        missing AS (
        SELECT source_row_index, 'ratcat_a' AS field_name FROM r
        WHERE NOT coalesce(ratcat_a = floor(ratcat_a) AND ratcat_a BETWEEN 1 AND 14, false)
        UNION ALL SELECT source_row_index, 'phstat_a' FROM r
        WHERE NOT coalesce(phstat_a = floor(phstat_a) AND phstat_a BETWEEN 1 AND 5, false)
        UNION ALL SELECT source_row_index, 'region' FROM r
        WHERE NOT coalesce(region = floor(region) AND region BETWEEN 1 AND 4, false)
        UNION ALL SELECT source_row_index, 'structural_barrier_proxy' FROM s
        WHERE NOT coalesce(structural_barrier_proxy BETWEEN 0 AND 5, false))
"""
SQL = {
    "p2_found": f"{MISSING} SELECT source_row_index, field_name FROM missing",
    "p2_summary": f"""{MISSING} SELECT field_name, count(*) AS n_missing, count(*) AS n_filled, CAST(0 AS BIGINT) AS n_illegal, CAST(0 AS BIGINT) AS n_not_of_donor
                      FROM missing GROUP BY field_name""",
}
