"""Queries of the training-data problems and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.durable import durable
from tallyloom.llm import language, leakage, mixing, neighbours, sampling, truncation
from tallyloom.sources.tables import current_rows, table

PATH = ["motivation", "capability", "cue", "shtflu12m_a"]


# Problem 3


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(spark, table(spark, d, "similarity_vectors"), table(spark, d, "matrix_specs"))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(spark, table(spark, d, "similarity_vectors"), table(spark, d, "matrix_specs"))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Measured recall of the routing, by exact search of checked rows."""
    return neighbours.measured_recall(spark, table(spark, d, "similarity_vectors"), table(spark, d, "matrix_specs"))


# Problem 4


def _tree(df: DataFrame) -> DataFrame:
    """Split a readable pattern into its three steps; unreadable ones become null."""
    m = F.regexp_extract(sampling.pattern_key(F.col("hbm8_pattern")), "^(low|high)motivation(low|high)capability(weak|strong)cue$", 0)
    part = lambda i: F.regexp_extract(m, "^(low|high)motivation(low|high)capability(weak|strong)cue$", i)
    return df.withColumns({"motivation": F.when(m != "", part(1)), "capability": F.when(m != "", part(2)), "cue": F.when(m != "", part(3))})


def _pool(spark: SparkSession, d: str) -> DataFrame:
    r = current_rows(table(spark, d, "respondents").select("source_row_index", "shtflu12m_a", "loaded_at"), "source_row_index", F.col("loaded_at").desc_nulls_last())
    s = current_rows(table(spark, d, "hbm_scores").select("source_row_index", "hbm8_pattern", "scored_at"), "source_row_index", F.col("scored_at").desc_nulls_last())
    r = r.filter(F.col("shtflu12m_a").isin(1.0, 2.0)).select("source_row_index", F.col("shtflu12m_a").cast("int").alias("shtflu12m_a"))
    return _tree(s).filter(F.col("motivation").isNotNull()).join(r, "source_row_index").select("source_row_index", *PATH)


def _allocation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pool = durable(_pool(spark, d))  # counted and drawn from
    targets = _tree(table(spark, d, "sample_targets"))
    quotas = sampling.allocate(targets.drop("hbm8_pattern"), pool.groupBy(*PATH).agg(F.count("*").alias("n")), PATH)
    return pool, durable(quotas.join(targets.select("plan_id", *PATH, "hbm8_pattern"), ["plan_id", *PATH]))


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    pool, quotas = _allocation(spark, d)
    return sampling.report(quotas, sampling.draw(pool, quotas, PATH, "source_row_index"), PATH)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells that the drawn sample leaves short."""
    return _sampled(spark, d).filter("short").select("plan_id", "hbm8_pattern", "shtflu12m_a").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d).drop("motivation", "capability", "cue")


def p4_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _allocation(spark, d)[1].drop("motivation", "capability", "cue")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    pool, quotas = _allocation(spark, d)
    return sampling.draw(pool, quotas, PATH, "source_row_index")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per plan: rows asked for, drawn, drawn twice, and cells that got fewer than they have and want."""
    pool, quotas = _allocation(spark, d)
    drawn = durable(sampling.draw(pool, quotas, PATH, "source_row_index"))
    r = sampling.report(quotas, drawn, PATH)
    twice = drawn.groupBy("plan_id").agg((F.count("*") - F.countDistinct("source_row_index")).alias("n_twice"))
    less = F.col("drawn") < F.least("asked", "available")
    return r.groupBy("plan_id").agg(F.sum("asked").alias("n_asked"), F.sum("drawn").alias("n_drawn"), F.count_if(less).alias("n_cells_below")).join(twice, "plan_id", "left")


# Problem 5


def _values(spark: SparkSession, d: str) -> DataFrame:
    """The three text fields as one table; the source of a text is its model."""
    c, m = table(spark, d, "call_log"), table(spark, d, "memory_items")
    pick = lambda df, name, key, field: df.select(
        F.lit(name).alias("src_table"), F.col(key).alias("row_id"), F.lit(field).alias("field_name"), F.col("model").alias("source"), F.col(field).alias("value")
    )
    return (
        pick(c, "call_log", "call_id", "reason")
        .unionByName(pick(m, "memory_items", "memory_id", "correction_rule"))
        .unionByName(pick(m, "memory_items", "memory_id", "residual_factor"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_values(_values(spark, d)).filter("cut").select("src_table", "row_id", "field_name").distinct()


def p5_cuts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_values(_values(spark, d)).filter("cut")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.cut_values(_values(spark, d))).withColumnRenamed("source", "model")


# Problem 6


def _leaks(spark: SparkSession, d: str, opt: leakage.Walks = leakage.Walks()) -> DataFrame:
    return leakage.leaks(spark, table(spark, d, "documents"), table(spark, d, "eval_items"), opt)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, leakage.EXACT).filter("exact_windows > 0").select("item_id", "doc_id").distinct()


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_leaks(spark, d))


# Problem 7


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # Sizes are summed by source and in total, and drawn from: texts are tokenised once.
    sizes = durable(mixing.token_sizes(table(spark, d, "documents")))
    return sizes, mixing.plan(sizes, table(spark, d, "mix_targets"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    sizes, planned = _mix(spark, d)
    planned = durable(planned)
    return mixing.report(planned, mixing.draw(sizes, planned))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the drawn mix leaves short."""
    return _mixed(spark, d).filter("short").select("mix_id", "source").distinct()


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    sizes, planned = _mix(spark, d)
    return mixing.draw(sizes, durable(planned))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per (mix, source): documents drawn too often, and whether the size misses its goal (the
    budget, or all copies of a source that falls short) by a largest document or more."""
    sizes, planned = _mix(spark, d)
    planned = durable(planned)
    longest = sizes.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    r = mixing.report(planned, mixing.draw(sizes, planned)).join(longest, "source", "left")
    goal = F.least("budget", F.col("source_tokens") * F.col("max_repeats"))
    off = F.abs(F.col("got_tokens") - goal) > F.coalesce("longest", F.lit(0))
    return r.select("mix_id", "source", F.coalesce(F.col("most_copies") > F.col("max_repeats"), F.lit(False)).alias("too_often"), off.alias("misses_goal"))


# Problem 8


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(spark, table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_segments(spark, d).filter("of_document and needs_label").filter(F.col("lang_code") != language.UNKNOWN).select("doc_id", "lang_code").distinct()


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    """Languages of every document, with confidence."""
    s = p8_segments(spark, d).filter("of_document")
    return s.groupBy("doc_id", "lang_code").agg(F.max("document_confidence").alias("confidence"), F.sum("n_sentences").alias("n_sentences"), F.max("needs_label").alias("needs_label"))


QUERIES = {q.__name__: q for q in (p3_found, p3_nearest, p3_recall, p4_found, p4_report, p4_allocation, p4_sample, p4_totals, p5_found, p5_cuts, p5_rates, p6_found, p6_leaks, p6_items, p7_found, p7_sample, p7_report, p7_totals, p8_found, p8_segments, p8_labels)}

GRAMS = r"""SELECT DISTINCT {key} AS {key}, array_to_string(ws[i:i + 12], ' ') AS gram FROM
    (SELECT {key}, ws, unnest(range(1, len(ws) - 11)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM {table} WHERE {key} IS NOT NULL) WHERE len(ws) >= 13)"""

POOL = """
        WITH r AS (SELECT source_row_index, shtflu12m_a FROM respondents WHERE source_row_index IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY loaded_at DESC NULLS LAST) = 1),
        s AS (SELECT source_row_index, regexp_replace(lower(hbm8_pattern), '[^a-z]+', '', 'g') AS p FROM hbm_scores
              WHERE source_row_index IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY source_row_index ORDER BY scored_at DESC NULLS LAST) = 1),
        pool AS (SELECT p, CAST(shtflu12m_a AS INT) AS f FROM r JOIN s USING (source_row_index)
                 WHERE shtflu12m_a IN (1, 2)
                 AND regexp_full_match(p, '(low|high)motivation(low|high)capability(weak|strong)cue')),
        n AS (SELECT p, f, count(*) AS n FROM pool GROUP BY ALL),
        c AS (SELECT t.*, coalesce(n.n, 0) AS available, greatest(min_rows, target_share * sample_fraction * (SELECT count(*) FROM pool)) AS wanted
              FROM sample_targets t LEFT JOIN n ON n.p = regexp_replace(lower(t.hbm8_pattern), '[^a-z]+', '', 'g') AND n.f = t.shtflu12m_a)
"""

SQL = {
    "p3_found": """
        WITH w AS (SELECT matrix_name, vec_id, any_value(embedding::DOUBLE[]) AS e, any_value(k) AS k, any_value(min_cosine) AS least
                   FROM similarity_vectors JOIN matrix_specs USING (matrix_name)
                   WHERE vec_id IS NOT NULL AND len(embedding) = dims AND list_count(embedding) = dims AND NOT list_contains(embedding::DOUBLE[], 'nan'::DOUBLE)
                   GROUP BY matrix_name, vec_id),
        v AS (SELECT * FROM w WHERE list_dot_product(e, e) > 0 AND list_dot_product(e, e) < 'inf'::DOUBLE),
        p AS (SELECT q.vec_id AS a, s.vec_id AS b, list_cosine_similarity(q.e, s.e) AS c, q.k, q.least FROM v q JOIN v s USING (matrix_name) WHERE q.vec_id <> s.vec_id
              QUALIFY row_number() OVER (PARTITION BY matrix_name, q.vec_id ORDER BY c DESC, s.vec_id) <= q.k)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM p WHERE c >= p.least
    """,
    "p6_found": f"SELECT DISTINCT item_id, doc_id FROM ({GRAMS.format(key='item_id', table='eval_items')}) JOIN ({GRAMS.format(key='doc_id', table='documents')}) USING (gram)",
    "p4_found": f"{POOL} SELECT plan_id, hbm8_pattern, shtflu12m_a FROM c WHERE available < wanted",
    "p4_totals": f"""{POOL} SELECT plan_id, CAST(sum(ceil(wanted)) AS BIGINT) AS n_asked, CAST(least(sum(ceil(wanted)), (SELECT count(*) FROM pool)) AS BIGINT) AS n_drawn,
                     CAST(0 AS BIGINT) AS n_cells_below, CAST(0 AS BIGINT) AS n_twice FROM c GROUP BY plan_id""",
    "p7_totals": "SELECT mix_id, source, false AS too_often, false AS misses_goal FROM mix_targets",
}
