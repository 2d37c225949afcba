"""A sample whose category shares meet given targets, by top-down allocation over a category tree.

Categories are paths in a tree (motivation, capability, cue, outcome). The sample size goes from
the root down: a node asks for the sum of its leaves' targets, each leaf for the larger of its
share and its minimum. What a leaf's rows cannot supply is unmet and is passed to its siblings
first, then to cousins, level by level up to the root, always to leaves with rows to spare and in
proportion to them. Rows are drawn at the leaves by permuted dense rank: a hash of (seed, plan,
id) puts the rows of a leaf in random order and the first ones up to the quota are taken
(:func:`tallyloom.operators.ranked.take_prefix`, no window over a whole leaf).

Allocation runs on one row per plan and leaf: the number of categories, not of records. It is
made of windows over a plan's leaves.

Results for unusual input: rows with an unreadable category are outside the pool; leaves without
rows have their whole quota unmet; targets that are null count as 0. With an empty pool all
quotas are 0. Repeated targets of one cell must not occur. A plan's total never exceeds the pool.
Shares of counts are taken in decimal arithmetic, so counts may be as large as longs are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.ranked import take_prefix, unit_hash


def pattern_key(c: Column) -> Column:
    """A pattern's letters regardless of case, spacing and separator."""
    return F.regexp_replace(F.lower(c), "[^a-z]+", "")


def allocate(targets: DataFrame, pool_counts: DataFrame, path: list[str]) -> DataFrame:
    """Quota, unmet amount and spill of each (plan, leaf).

    ``targets``: plan_id, the path columns, target_share, min_rows, sample_fraction.
    ``pool_counts``: the path columns and n (rows of the pool).
    Adds ``available``, ``pool_size``, ``wanted`` (the larger of share and minimum, exact),
    ``asked`` (whole rows), ``quota`` (rows to draw), ``received`` (of it, from other leaves), ``short``
    (own rows below ``wanted``), ``unmet`` (rows that no leaf could take over).
    """
    total = pool_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pool_size"))
    leaf = ["plan_id", *path]
    t = (
        targets.join(pool_counts.withColumnRenamed("n", "available"), path, "left")
        .join(F.broadcast(total))  # one row
        .withColumn("available", F.coalesce("available", F.lit(0)))
    )
    share = F.coalesce(F.col("target_share") * F.col("sample_fraction") * F.col("pool_size"), F.lit(0.0))
    t = t.withColumn("wanted", F.greatest(F.coalesce(F.col("min_rows").cast("double"), F.lit(0.0)), share))
    t = t.withColumn("asked", F.ceil("wanted").cast("long"))
    t = t.withColumns(
        {
            "quota": F.least("asked", "available"),
            "unmet": F.greatest(F.col("asked") - F.col("available"), F.lit(0)),
            "spare": F.greatest(F.col("available") - F.col("asked"), F.lit(0)),
            "received": F.lit(0).cast("long"),
        }
    )
    # Siblings share all of the path but its last step, cousins one step less, and so on.
    for depth in range(len(path) - 1, -1, -1):
        node = Window.partitionBy("plan_id", *path[:depth])
        first = node.orderBy(F.col("spare").desc(), *path)
        need, room = F.sum("unmet").over(node), F.sum("spare").over(node)
        t = t.withColumns({"__move": F.least(need, room), "__room": room, "__need": need})
        # Largest whole parts in proportion to the spare rows; cumulative rounding adds up exactly.
        upto = F.sum("spare").over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        left = F.sum("unmet").over(node.orderBy(F.col("unmet").desc(), *path).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
        cut = lambda cum, whole: F.when(F.col(whole) > 0, F.expr(f"{big(cum)} * {big('__move')} DIV {big(whole)}")).otherwise(F.lit(0).cast("long"))
        t = t.withColumns({"__upto": upto, "__left": left})
        t = t.withColumns(
            {
                "__gain": cut("__upto", "__room") - cut("__upto - spare", "__room"),
                "__gone": cut("__left", "__need") - cut("__left - unmet", "__need"),
            }
        )
        t = t.withColumns(
            {
                "quota": F.col("quota") + F.col("__gain"), "received": F.col("received") + F.col("__gain"),
                "spare": F.col("spare") - F.col("__gain"), "unmet": F.col("unmet") - F.col("__gone"),
            }
        ).drop("__move", "__room", "__need", "__upto", "__left", "__gain", "__gone")
    return t.select(*leaf, "target_share", "min_rows", "sample_fraction", "pool_size", "available", "wanted", "asked", "quota", "received", (F.col("quota") - F.col("received") < F.col("wanted")).alias("short"), "unmet")


def draw(pool: DataFrame, quotas: DataFrame, path: list[str], key: str, seed: int = 11) -> DataFrame:
    """The sampled rows: plan_id, key and the path columns."""
    rows = pool.select(key, *path).join(quotas.select("plan_id", *path), path)
    rows = rows.withColumn("__u", unit_hash(seed, "plan_id", key))
    return take_prefix(rows, ["plan_id", *path], "__u", key, quotas, "quota").select("plan_id", key, *path)


def report(quotas: DataFrame, drawn: DataFrame, path: list[str]) -> DataFrame:
    """The quotas with ``drawn`` rows, their ``actual_share`` of the plan's sample, and ``short``.

    A cell is short if the rows drawn in it, without those it took over from other cells, are fewer
    than wanted.
    """
    leaf = ["plan_id", *path]
    n = quotas.select(*leaf, "quota", "received", "wanted").join(drawn.groupBy(*leaf).agg(F.count("*").alias("drawn")), leaf, "left")
    n = n.withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    whole = F.sum("drawn").over(Window.partitionBy("plan_id"))  # one row a leaf
    n = n.withColumns({"actual_share": F.coalesce(F.try_divide("drawn", whole), F.lit(0.0)), "short": F.col("drawn") - F.col("received") < F.col("wanted")})
    return quotas.drop("short").join(n.select(*leaf, "drawn", "actual_share", "short"), leaf)
