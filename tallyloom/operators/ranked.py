"""Prefixes of a random or given order, taken exactly and without a global or hot window.

``take_prefix`` keeps, per group, the first rows of an order until a quota is met. Rows are first
counted per (group, bin of the order key), with map-side combining; a window over the bins, at
most ``bins`` rows a group, finds the bin in which the quota ends. Only this end, one row a group,
is brought to the rows: rows of earlier bins are kept where they are, later ones dropped, and only
the rows of that one bin are shuffled and ranked. A group with a third of all rows thus ranks about
1/bins of them in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.durable import durable

#: Most groups whose ends are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def unit_hash(seed: int, *cols: str | Column) -> Column:
    """A uniform number in (0, 1) from a hash of the columns; the same for the same values."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * (2.0**-53)


def cumulate(values: DataFrame, by: Sequence[str], value: str, amounts: Sequence[str], bins: int = 4096) -> DataFrame:
    """Add ``<amount>_before``: the sum over smaller values of the same group.

    ``values``: one row per group and distinct, non-null value, read three times. The values are laid in bins between the
    smallest and the greatest of their group; sums run over the bins first and then within each
    bin, so no task holds all values of a group (unless they crowd in one of the bins).
    """
    ends = values.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    wide = values.join(ends, list(by)) if by else values.join(F.broadcast(ends))  # one row
    place = F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    wide = wide.withColumn("__bin", F.coalesce(F.floor(place * (bins - 1)), F.lit(0)).cast("int")).drop("__lo", "__hi")
    over = Window.partitionBy(*(list(by) or [F.lit(1)])).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows a group
    sums = wide.groupBy(*by, "__bin").agg(*[F.sum(a).alias(f"__{a}") for a in amounts])
    sums = sums.select(*by, "__bin", *[F.coalesce(F.sum(f"__{a}").over(over), F.lit(0)).alias(f"__{a}") for a in amounts])
    inner = Window.partitionBy(*by, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = wide.join(sums, [*by, "__bin"])
    return out.withColumns({f"{a}_before": F.col(f"__{a}") + F.coalesce(F.sum(a).over(inner), F.lit(0)) for a in amounts}).drop("__bin", *[f"__{a}" for a in amounts])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, from counts of distinct values.

    ``shares``: column name to share. Null and NaN take no part.
    """
    x = durable(df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count("*").alias("__c")))
    at = cumulate(x, by, value, ["__c"])
    total = x.groupBy(*by).agg(F.sum("__c").alias("__n"))
    at = at.join(total, list(by)) if by else at.join(F.broadcast(total))  # one row
    row = lambda r: F.max(F.when((F.col("__c_before") <= r) & (r < F.col("__c_before") + F.col("__c")), F.col(value)))
    out = []
    for name, q in shares.items():
        r = (F.col("__n") - 1) * q
        out += [row(F.floor(r)).alias(f"__a_{name}"), row(F.ceil(r)).alias(f"__b_{name}"), F.max(r - F.floor(r)).alias(f"__f_{name}")]
    found = at.groupBy(*by).agg(*out)
    return found.select(*by, *[(F.col(f"__a_{n}") + F.col(f"__f_{n}") * (F.col(f"__b_{n}") - F.col(f"__a_{n}"))).alias(n) for n in shares])


def take_prefix(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    tie: str,
    quotas: DataFrame,
    quota: str,
    size: str | None = None,
    bins: int = 4096,
    mark: str | None = None,
) -> DataFrame:
    """Rows of each group in ascending (order, tie) until the quota is met.

    ``order``: column with values in [0, 1). ``size``: column to sum instead of counting rows; a
    row is kept while the sum of the rows before it is below the quota, so the last kept row may
    pass it. ``quotas``: one row per group. Rows of groups without a quota, or with a null, zero or
    negative one, are not taken. ``mark``: keep all rows and say in this column which are taken.
    """
    amount = F.col(size).cast("double") if size else F.lit(1.0)
    binned = df.withColumn("__bin", F.least(F.floor(F.col(order) * bins), F.lit(bins - 1)).cast("int"))
    w = Window.partitionBy(*groups).orderBy("__bin")
    counted = binned.groupBy(*groups, "__bin").agg(F.sum(amount).alias("__n")).withColumn("__upto", F.sum("__n").over(w))
    wanted = quotas.select(*groups, F.col(quota).cast("double").alias("__quota")).filter("__quota > 0")
    over = F.when(F.col("__upto") >= F.col("__quota"), F.struct("__bin", (F.col("__quota") - (F.col("__upto") - F.col("__n"))).alias("room")))
    ends = counted.join(wanted, list(groups)).groupBy(*groups).agg(F.min(over).alias("e"))
    ends = durable(ends.select(*groups, F.coalesce("e.__bin", F.lit(bins)).alias("__end"), F.coalesce("e.room", F.lit(0.0)).alias("__room")))
    few = ends.count() <= BROADCAST_GROUPS
    placed = binned.join(F.broadcast(ends) if few else ends, list(groups), "left" if mark else "inner")
    inner = Window.partitionBy(*groups).orderBy(order, tie)
    before = F.coalesce(F.sum(amount).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sure = F.col("__end").isNull() | (F.col("__bin") != F.col("__end"))
    here = placed.filter(~sure).withColumn("__taken", before < F.col("__room"))
    out = placed.filter(sure).withColumn("__taken", F.coalesce(F.col("__bin") < F.col("__end"), F.lit(False))).unionByName(here)
    out = out.withColumnRenamed("__taken", mark) if mark else out.filter("__taken").drop("__taken")
    return out.drop("__bin", "__room", "__end")
