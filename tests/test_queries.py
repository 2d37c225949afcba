"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if n.startswith("q_") or n[:3] in ("p1_", "p2_")]
SLOW = {"q_oof_residual", "q_reward_revision", "q_classifiers", "q_nonneg_logit", "q_latent_map"}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if not isinstance(v, (list, dict)) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(norm(v) for v in r) for r in duck.sql(f"SELECT {names} FROM ({SQL[name]})").fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL and n not in SLOW])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_point():
    assert set(SQL) <= set(QUERIES) and "q_flagship" in QUERIES
