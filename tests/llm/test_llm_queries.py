import os

import duckdb
import pytest

from tallyloom.llm.queries import QUERIES, SQL

COLUMNS = {
    "p3_found": ["vec_id_a", "vec_id_b"], "p4_found": ["plan_id", "hbm8_pattern", "shtflu12m_a"], "p5_found": ["src_table", "row_id", "field_name"],
    "p6_found": ["item_id", "doc_id"], "p7_found": ["mix_id", "source"], "p8_found": ["doc_id", "lang_code"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))


def test_shortage_against_sql(spark, data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    assert {tuple(r) for r in QUERIES["p4_found"](spark, data).collect()} == {tuple(r) for r in c.sql(SQL["p4_found"]).fetchall()}


def test_samples_and_reports(spark, data):
    for name in ("p4_sample", "p5_rates", "p6_items", "p7_report", "p8_labels"):
        assert QUERIES[name](spark, data).count() > 0
