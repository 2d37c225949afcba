"""Deterministic splits and quota samples.

Random order is a hash of the id, so membership does not depend on partitioning. Strata are first
counted; rows are then taken by rank within their stratum. Ranks of a hot stratum are computed in
hash buckets (:func:`dense_order`), not in one window over the stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: multiplicative hash constant (golden ratio of 2^32).
KNUTH = 2654435761


def hash32(key: str | Column, seed: int = 42) -> Column:
    """A 32-bit multiplicative hash that other SQL engines can restate with plain arithmetic."""
    k = F.pmod(F.col(key).cast("long") if isinstance(key, str) else key.cast("long"), F.lit(2**31))
    mixed = F.pmod(k * KNUTH + F.lit(seed * 40503), F.lit(2**32))
    return F.pmod(F.shiftright(mixed, 7) * KNUTH + mixed, F.lit(2**32))


def dense_order(df: DataFrame, strata: Sequence[str], key: str, seed: int = 42, bits: int = 10) -> DataFrame:
    """Add ``rank0``: position 0.. of a row within its stratum in (hash, key) order.

    Ranks are the row's rank in its (stratum, hash bucket) plus the number of rows in earlier
    buckets, so the window of a stratum is spread over 2^bits tasks.
    """
    h = df.withColumn("__h", hash32(key, seed)).withColumn("__b", F.shiftright("__h", 32 - bits))
    keys = list(strata) or [F.lit(1)]
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = h.groupBy(*strata, "__b").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    renamed = counts.select(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)], F.col("__b").alias("__bb"), "__before")
    on = F.col("__b") == F.col("__bb")
    for i, s in enumerate(strata):
        on = on & F.col(s).eqNullSafe(F.col(f"__s{i}"))
    inner = Window.partitionBy(*strata, "__b").orderBy("__h", key)
    out = h.join(renamed, on).withColumn("rank0", F.col("__before") + F.row_number().over(inner) - 1)
    return out.drop("__h", "__b", "__bb", "__before", *[f"__s{i}" for i in range(len(strata))])


def allocate(counts: DataFrame, weight: str, total: int | Column, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Largest-remainder allocation: add ``quota`` so that quotas sum to the total.

    Floors first, the rest to the largest fractions (ties by ``order``). ``counts`` has a row per
    stratum.
    """
    keys = list(within) or [F.lit(1)]
    part = Window.partitionBy(*keys)
    exact = F.col(weight) / F.sum(weight).over(part) * (total if isinstance(total, Column) else F.lit(total))
    q = counts.withColumn("__e", exact).withColumn("__f", F.floor(F.round("__e", 9)))
    rest = F.round((total if isinstance(total, Column) else F.lit(total)) - F.sum("__f").over(part))
    rank = F.row_number().over(part.orderBy(F.round(F.col("__e") - F.col("__f"), 9).desc(), *order))
    return q.withColumns({"__rest": rest, "__rank": rank}).withColumn("quota", (F.col("__f") + (F.col("__rank") <= F.col("__rest")).cast("long")).cast("long")).drop("__e", "__f", "__rest", "__rank")


def three_way(df: DataFrame, strata: Sequence[str], key: str, seed: int = 42, shares: tuple[float, float] = (0.4, 0.2)) -> DataFrame:
    """Add split: memory, calibration or test in about 40/20/40 of every stratum."""
    n = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    m = F.round(F.col("__n") * shares[0])
    c = F.round(F.col("__n") * (shares[0] + shares[1]))
    sizes = n.select(*[F.col(s).alias(f"__k{i}") for i, s in enumerate(strata)], m.alias("__m"), c.alias("__c"))
    on = F.lit(True)
    for i, s in enumerate(strata):
        on = on & F.col(s).eqNullSafe(F.col(f"__k{i}"))
    ranked = dense_order(df, strata, key, seed).join(sizes, on)
    split = F.when(F.col("rank0") < F.col("__m"), "memory").when(F.col("rank0") < F.col("__c"), "calibration").otherwise("test")
    return ranked.withColumn("split", split).drop("rank0", "__m", "__c", *[f"__k{i}" for i in range(len(strata))])


def folds(df: DataFrame, strata: Sequence[str], key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add fold 0..k-1, even within every stratum."""
    return dense_order(df, strata, key, seed).withColumn("fold", F.pmod("rank0", F.lit(k)).cast("int")).drop("rank0")


def quota_sample(df: DataFrame, strata: Sequence[str], key: str, total: int, seed: int = 42, balanced: bool = False) -> DataFrame:
    """``total`` rows, proportional to the strata (or equal shares), by rank within the stratum.

    What a stratum lacks under equal shares is not topped up.
    """
    n = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    n = allocate(n.withColumn("__w", F.lit(1.0) if balanced else F.col("__n").cast("double")), "__w", total, strata)
    return dense_order(df, strata, key, seed).join(n.select(*strata, "quota"), list(strata)).filter("rank0 < quota").drop("rank0", "quota")


def downsample(df: DataFrame, strata: Sequence[str], key: str, total: int, seed: int = 42) -> DataFrame:
    """About ``total`` rows with at least one of every stratum: max(1, round(share))."""
    n = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    share = F.col("__n") * total / F.sum("__n").over(Window.partitionBy(F.lit(1)))  # one row a stratum
    n = n.withColumn("quota", F.least(F.greatest(F.round(share), F.lit(1.0)), F.col("__n"))).select(*strata, "quota")
    return dense_order(df, strata, key, seed).join(n, list(strata)).filter("rank0 < quota").drop("rank0", "quota")


def order_splits(df: DataFrame, key: str = "source_row_index", split: str = "split") -> DataFrame:
    """Add data_idx 0.. in the order memory, calibration, test, then key.

    Positions are counts of earlier (split, key range) blocks plus the rank in the block.
    """
    place = F.when(F.col(split) == "memory", 0).when(F.col(split) == "calibration", 1).otherwise(2)
    d = df.withColumns({"__p": place, "__r": F.floor(F.col(key) / 65536)})
    w = Window.partitionBy(F.lit(1)).orderBy("__p", "__r").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = d.groupBy("__p", "__r").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    inner = Window.partitionBy("__p", "__r").orderBy(key)
    return d.join(blocks.drop("__c"), ["__p", "__r"]).withColumn("data_idx", F.col("__before") + F.row_number().over(inner) - 1).drop("__p", "__r", "__before")


def check_reference_split(df: DataFrame, ids: DataFrame, key: str = "source_row_index", strict: bool = True) -> DataFrame:
    """A split table with renamed columns, lower-case splits and only known ids.

    Accepts source_index or source_row_index, and phase or split. ``strict`` raises on duplicate or
    unknown ids, otherwise they are dropped.
    """
    names = {c: key for c in ("source_index", key) if c in df.columns} | {c: "split" for c in ("phase", "split") if c in df.columns}
    out = df.select(*[F.col(a).alias(b) for a, b in names.items()]).withColumn("split", F.lower(F.trim("split")))
    out = out.filter(F.col("split").isin("memory", "calibration", "test"))
    if strict:
        bad = out.groupBy(key).count().filter("count > 1").select(key).unionByName(out.join(ids, key, "left_anti").select(key)).limit(1).collect()
        if bad:
            raise ValueError(f"duplicate or unknown id in the split: {bad[0][0]}")
        return out
    return out.dropDuplicates([key]).join(ids, key, "left_semi")
