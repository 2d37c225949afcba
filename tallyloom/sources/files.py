"""File sources and sinks: checked CSV, JSON configurations, logs, result tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyloom.functions.text import fingerprint


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], text: Sequence[str] = ("HHX",), row_id: str | None = "source_row_index") -> DataFrame:
    """Needed columns of a CSV as doubles (``text`` as strings); raises if one is missing.

    Text that is no number becomes null. The header alone is read for the check. ``row_id`` is the
    position over all files in order: rows are counted per block of a file first, and a row's place
    in its block is added to the rows before the block.
    """
    header = spark.read.csv(path, header=True).columns
    if absent := [c for c in columns if c not in header]:
        raise ValueError(f"columns missing in {path}: {absent}")
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path, header=True)
    out = raw.select(*[F.col(c) if c in text else F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    if row_id is None:
        return out
    block = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at")]
    # Ids ascend within a block; the same plan gives the same ids.
    placed = raw.select(*out.columns, *block)
    blocks = placed.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a block
    blocks = blocks.select("__file", "__start", (before - F.col("__first")).alias("__shift"))
    typed = placed.select(*[F.col(c) if c in text else F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(c) for c in columns], "__file", "__start", "__at")
    return typed.join(F.broadcast(blocks), ["__file", "__start"]).select(*columns, (F.col("__at") + F.col("__shift")).alias(row_id))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {absent}")
    return df


def forbid_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise if a plan's output holds a column that a variant must not see."""
    if leaks := [c for c in df.columns if c.lower() in {x.lower() for x in columns}]:
        raise ValueError(f"columns not allowed here: {leaks}")
    return df


def _file(spark: SparkSession, path: str):
    """Hadoop path and file system of a path on any storage that the session can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(path: str) -> str | None:
    """A small file as text, None if there is none."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return Path(path).read_text() if Path(path).exists() else None
    p, fs = _file(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(p) else None


def write_text(path: str, text: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_manifest(path: str, scenario: str, available: Sequence[str]) -> list[str]:
    """A scenario's columns that exist in the data."""
    return [c for c in json.loads(read_text(path))[scenario] if c in set(available)]


def read_overlay(path: str | None, defaults: Mapping[str, Mapping[str, float]]) -> dict[str, dict[str, float]]:
    """Defaults overlaid by a JSON file; unknown sections raise."""
    out = {k: dict(v) for k, v in defaults.items()}
    for section, values in (json.loads(read_text(path)) if path else {}).items():
        if section not in out:
            raise ValueError(f"unknown section {section}")
        out[section].update(values)
    return out


def read_support(path: str, memory: DataFrame, size: int = 8, key: str = "source_row_index", y: str = "actual") -> DataFrame:
    """A balanced support set: ``size`` rows, half of each label, all in memory with that label."""
    rows = json.loads(read_text(path))
    if len(rows) != size or sum(int(r["label"]) for r in rows) * 2 != size:
        raise ValueError(f"a support set has {size} rows, half of each label")
    s = memory.sparkSession.createDataFrame([(int(r[key]), int(r["label"])) for r in rows], f"{key} long, label int")
    if s.join(memory.select(key, F.col(y).alias("label")), [key, "label"], "left_anti").count():
        raise ValueError("support rows must be memory rows with the same label")
    return s


def write_config(path: str, config: Mapping, overwrite: bool = False) -> str:
    """Store a run's configuration; a folder of another run is refused. Returns the fingerprint."""
    file, h = f"{path}/config.json", fingerprint(config)
    known = read_text(file)
    if known and not overwrite and json.loads(known).get("hash") != h:
        raise ValueError(f"{path} holds a run with another configuration")
    write_text(file, json.dumps({"hash": h, "config": dict(config)}, sort_keys=True, indent=1, default=str))
    return h


def fit_or_load(path: str, config: Mapping, fit: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of a fitted model: stored ones if they were fitted with this configuration.

    A folder of another configuration is refused. The configuration is written last, so a fit that
    was broken off is done again.
    """
    spark, done = SparkSession.getActiveSession(), read_text(f"{path}/config.json")
    if done:
        stored = json.loads(done)
        if stored["hash"] != fingerprint(config):
            raise ValueError(f"{path} holds a model with another configuration")
        return {n: spark.read.parquet(f"{path}/{n}") for n in stored["tables"]}
    tables = fit()
    for n, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{n}")
    write_text(f"{path}/config.json", json.dumps({"hash": fingerprint(config), "config": dict(config), "tables": sorted(tables)}, sort_keys=True, default=str))
    return {n: spark.read.parquet(f"{path}/{n}") for n in tables}


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").format(fmt)
    w = w.partitionBy(*by) if by else w
    (w.option("header", True) if fmt == "csv" else w).save(path)


def safe_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text; NaN and infinities are null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c)
    return df.select(F.to_json(F.struct(*[ok(c) if c in floats else F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (variant, model) of stored result folders variant=.../model=..."""
    return spark.read.parquet(root).select("variant", "model").distinct()
