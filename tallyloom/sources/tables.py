"""Readers for the Parquet tables, with one rule set for dirty numerics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Parquet keeps pruning and pushdown."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float column (Spark orders NaN above all numbers)."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def current_rows(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that comes first in ``order``; null keys are dropped.

    A window with row_number()=1 becomes a WindowGroupLimit, so all but one row of a key are
    dropped before the shuffle. Ties beyond ``order`` are broken arbitrarily, therefore callers
    order by all columns that may differ.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return (
        df.filter(F.col(key).isNotNull())
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") == 1)
        .drop("__rn")
    )
