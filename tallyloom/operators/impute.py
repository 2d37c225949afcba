"""Group-aware predictive mean matching on a prediction grid.

Each missing value is filled with the observed value of a donor whose prediction is near that of
the recipient, so every filled value is one that really occurs.

1. Fit, per field, a ridge regression on standardised features and on the shrunken means of the
   groups. The means of all group levels come from one aggregation by all group columns. Partitions
   send their sums of products (a few hundred numbers), the driver solves. A nominal field is first
   given category scores, those that the features explain best.
2. Predictions are laid on a grid (``cells_per_sd`` cells per standard deviation of the
   predictions; beyond ``even_cells`` the cells grow in proportion to the distance from zero, so
   that any prediction has a cell and the number of cells stays bounded). Donors and recipients
   are counted per group and cell, with map-side combining.
3. Range search on the counts: two running windows over the cells of a group find the nearest
   cell with donors at either side. The finest group level whose nearest cell lies within
   ``caliper`` cells is used; the last level is the whole table and takes any distance.
4. Draw: the donors of a cell are divided by a hash into slots of about ``donors`` rows, a
   recipient draws a slot and a donor in it. Every donor of the cell can be drawn; slots that no
   recipient can ask for are not moved. No group or cell is ever gathered in a task. (A cell of
   ``donors`` rows or fewer is one slot. An empty slot has a chance below 1e-13 and would leave
   its recipient unfilled and marked so.)

Results for unusual input: nulls, NaN and illegal values are missing; a null id takes no part. A
field without any donor leaves its rows unfilled (``filled_value`` null). Null groups form a group
of their own. Null and NaN features count as the mean. Repeated rows must be removed before
(:func:`tallyloom.sources.tables.current_rows`). Other columns are ignored. An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.durable import durable


@dataclass(frozen=True)
class Field:
    """A column to fill, with its legal values. ``nominal``: codes without order."""

    name: str
    low: float
    high: float
    whole: bool = True
    nominal: bool = False
    where: str | None = None  # boolean column: the field applies to the row

    def legal(self, c: Column) -> Column:
        ok = c.isNotNull() & ~F.isnan(c) & (c >= self.low) & (c <= self.high)
        return ok & (c == F.floor(c)) if self.whole else ok

    @property
    def codes(self) -> list[float]:
        return [float(v) for v in range(int(self.low), int(self.high) + 1)] if self.nominal else []


@dataclass(frozen=True)
class Matching:
    cells_per_sd: int = 32
    even_cells: int = 512
    donors: int = 32
    caliper: int = 16
    shrink: float = 20.0
    ridge: float = 1.0
    seed: int = 7


#: Tables of at most so many rows (about 100 bytes each) are broadcast, after they were counted.
BROADCAST_ROWS = 200_000
#: Recipients a copy of a slot serves; slots with more are copied.
SERVED = 10_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _gram(names: list[str], fields: Sequence[Field], n_levels: int, n_y: int):
    """Sums of products of (1, features, group effects, targets) per field, one set a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            x = [get(f"x_{i}") for i in range(len(names))]
            for j, f in enumerate(fields):
                y = get(f"y_{j}")
                at = np.flatnonzero(~np.isnan(y))
                if not len(at):
                    continue
                one, zero = np.ones(len(at)), np.zeros(len(at))
                cols = [one, *[zero if n == f.name else v[at] for n, v in zip(names, x)], *[get(f"e_{i}_{j}")[at] for i in range(n_levels)]]
                goal = [(y[at] == v).astype(float) for v in f.codes] if f.nominal else [y[at]]
                z = np.stack(cols + goal + [zero] * (n_y - len(goal)), axis=1)
                total[j] = total.get(j, 0.0) + z.T @ z
        for j, g in total.items():
            r, c = np.indices(g.shape)
            arrays = [pa.array(np.full(g.size, j, np.int32)), pa.array(r.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(g.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, names=["f", "i", "j", "v"])

    return run


def _solve(g: np.ndarray, n_x: int, n_y: int, ridge: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients (intercept first), sd of the predictions, scores of the categories."""
    n = g[0, 0]
    if n < 1:
        return np.zeros(n_x), 1.0, np.ones(n_y)
    a = g[:n_x, :n_x] + np.diag([0.0] + [ridge] * (n_x - 1))
    b = np.linalg.lstsq(a, g[:n_x, n_x : n_x + n_y], rcond=None)[0]
    mean = g[:n_x, 0] / n
    cov_x = g[:n_x, :n_x] / n - np.outer(mean, mean)
    scores = np.ones(1)
    if n_y > 1:
        my = g[n_x : n_x + n_y, 0] / n
        total = g[n_x : n_x + n_y, n_x : n_x + n_y] / n - np.outer(my, my) + 1e-6 * np.eye(n_y)
        half = np.linalg.inv(np.linalg.cholesky(total))
        explained = half @ (b.T @ cov_x @ b) @ half.T
        scores = half.T @ np.linalg.eigh(explained)[1][:, -1]
        scores *= 1.0 if scores[np.argmax(np.abs(scores))] > 0 else -1.0
    beta = b @ scores
    sd = float(np.sqrt(max(beta @ cov_x @ beta, 0.0)))
    return beta, sd if sd > 1e-9 else 1.0, scores


def impute(
    df: DataFrame,
    key: str,
    fields: Sequence[Field],
    features: dict[str, Column],
    groups: Sequence[Sequence[str]],
    opt: Matching = Matching(),
) -> DataFrame:
    """One row per missing value with its fill; see the module's docstring.

    ``groups``: group levels, finest first, each a list of columns; the whole table is added last.
    Columns: key, ``field_name``, ``filled_value``, ``donor_id``, ``group_level`` (the number of
    levels means the whole table), ``prediction``, ``donor_distance`` (in cells), ``was_filled``.
    """
    names, last = list(features), len(groups)
    by = list(dict.fromkeys(c for g in groups for c in g))
    own = [f"g_{i}" for i in range(len(by))]
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    applies = lambda f: F.coalesce(F.col(f.where), F.lit(False)) if f.where else F.lit(True)
    value = lambda f: F.when(f.legal(F.col(f.name).cast("double")), F.col(f.name).cast("double"))
    # Read below by the moments, the group means, the fit and the placing.
    base = durable(
        df.filter(F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("id"), *[group(c).alias(o) for c, o in zip(by, own)],
            *[applies(f).alias(f"a_{j}") for j, f in enumerate(fields)], *[F.when(applies(f), value(f)).alias(f"y_{j}") for j, f in enumerate(fields)],
            *[F.nanvl(c.cast("double"), F.lit(None)).alias(f"x_{i}") for i, c in enumerate(features.values())],
        )
    )
    m = base.agg(*[F.avg(f"x_{i}").alias(f"m_{i}") for i in range(len(names))], *[F.stddev_pop(f"x_{i}").alias(f"s_{i}") for i in range(len(names))]).first()
    x = [F.coalesce((F.col(f"x_{i}") - F.lit(m[f"m_{i}"])) / F.lit(m[f"s_{i}"] or 1.0), F.lit(0.0)) for i in range(len(names))]
    # Sums by all group columns; the levels are rolled up from them.
    sums = [c for j in range(len(fields)) for c in (F.sum(f"y_{j}").alias(f"s_{j}"), F.count(f"y_{j}").alias(f"n_{j}"))]
    cube = durable(base.groupBy(*own).agg(*sums))
    whole = cube.agg(F.count("*").alias("groups"), *[F.coalesce(F.sum(f"s_{j}") / F.sum(f"n_{j}"), F.lit(0.0)).alias(f"m_{j}") for j in range(len(fields))]).first()
    effects = cube.select(*own)
    for i, g in enumerate(groups):
        cols, part = [own[by.index(c)] for c in g], []
        for j in range(len(fields)):
            mean = float(whole[f"m_{j}"])
            part.append(((F.coalesce(F.sum(f"s_{j}"), F.lit(0.0)) - mean * F.sum(f"n_{j}")) / (F.sum(f"n_{j}") + opt.shrink)).alias(f"e_{i}_{j}"))
        effects = effects.join(_small(cube.groupBy(*cols).agg(*part), whole["groups"]), cols)
    if groups:
        wide = base.join(_small(effects, whole["groups"]), own)
    else:
        wide = base
    n_x, n_y = 1 + len(names) + last, max(1, *[len(f.codes) for f in fields])
    wide = wide.withColumns({f"x_{i}": c for i, c in enumerate(x)})
    flat = [*[f"x_{i}" for i in range(len(x))], *[f"e_{i}_{j}" for i in range(last) for j in range(len(fields))], *[f"y_{j}" for j in range(len(fields))]]
    grams = wide.select(*flat).mapInArrow(_gram(names, fields, last, n_y), "f int, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v")).collect()
    predicted, placed = {}, ["id", *own]
    for j, f in enumerate(fields):
        g = np.zeros((n_x + n_y, n_x + n_y))
        for r in grams:
            if r["f"] == j:
                g[r["i"], r["j"]] = r["v"]
        beta, sd, _ = _solve(g, n_x, len(f.codes) or 1, opt.ridge)
        terms = [f"x_{i}" if n != f.name else None for i, n in enumerate(names)] + [f"e_{i}_{j}" for i in range(last)]
        predicted[f"p_{j}"] = sum((F.col(t) * float(b) for t, b in zip(terms, beta[1:]) if t), F.lit(float(beta[0])))
        cell = grid(F.col(f"p_{j}") / (sd / opt.cells_per_sd), opt.even_cells)
        placed.append(F.when(F.col(f"a_{j}"), F.struct(F.lit(j).alias("f"), F.col(f"y_{j}").alias("y"), F.col(f"p_{j}").alias("p"), cell.alias("cell"))).alias(f"v_{j}"))
    # Read below by the counts, the recipients and the donors.
    kept = durable(wide.withColumns(predicted).select(*placed))
    rows = kept.select("id", *own, F.explode(F.filter(F.array(*[f"v_{j}" for j in range(len(fields))]), lambda v: v.isNotNull())).alias("v")).select("id", *own, "v.*")
    levels = [F.struct(F.lit(i).alias("lvl"), F.concat_ws("|", *[own[by.index(c)] for c in g]).alias("grp")) for i, g in enumerate(groups)]
    levels.append(F.struct(F.lit(last).alias("lvl"), F.lit("*").alias("grp")))
    fine = durable(rows.groupBy(*own, "f", "cell").agg(F.count("y").alias("nd"), F.count_if(F.col("y").isNull()).alias("nr")))
    cells = fine.select(F.inline(F.array(*levels)), "f", "cell", "nd", "nr").groupBy("f", "lvl", "grp", "cell").agg(F.sum("nd").alias("nd"), F.sum("nr").alias("nr"))
    donor = F.when(F.col("nd") > 0, F.struct("cell", "nd"))
    upto = lambda *order: Window.partitionBy("f", "lvl", "grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = cells.withColumn("lo", F.last(donor, ignorenulls=True).over(upto("cell"))).withColumn("hi", F.last(donor, ignorenulls=True).over(upto(F.col("cell").desc())))
    take_lo = F.col("hi").isNull() | (F.col("cell") - F.col("lo.cell") <= F.col("hi.cell") - F.col("cell"))
    near = near.filter("nr > 0").select("f", "lvl", "grp", "cell", F.when(take_lo, F.col("lo")).otherwise(F.col("hi")).alias("t")).filter("t is not null")
    near = near.select("f", "lvl", "grp", "cell", F.col("t.cell").alias("to"), F.col("t.nd").alias("n"), F.abs(F.col("t.cell") - F.col("cell")).alias("dist"))
    near = near.filter((F.col("dist") <= opt.caliper) | (F.col("lvl") == last))
    at = ["f", "lvl", "grp", "to"]
    routes = fine.filter("nr > 0").select(*own, F.inline(F.array(*levels)), "f", "cell", "nr").join(near, ["f", "lvl", "grp", "cell"])
    routes = durable(routes.groupBy(*own, "f", "cell").agg(F.first("nr").alias("nr"), F.min(F.struct("lvl", "grp", "to", "dist", "n")).alias("t")).select(*own, "f", "cell", "nr", "t.*"))
    slots = F.greatest(F.floor(F.col("n") / opt.donors), F.lit(1))
    asked = routes.groupBy(*at).agg(F.sum("nr").alias("r"), F.first("n").alias("n")).withColumn("slots", slots).withColumn("used", F.least("slots", "r"))
    asked = durable(asked.select(*at, "slots", "used", F.ceil(F.col("r") / F.col("used") / SERVED).cast("int").alias("copies")))
    size = asked.groupBy("lvl").count().collect()
    n_routes, n_asked = routes.count(), sum(r["count"] for r in size)
    h = lambda seed: F.xxhash64(F.lit(opt.seed + seed), "id", "f")
    pool = rows.filter("y is not null").select("id", "f", "y", F.col("cell").alias("to"), F.inline(F.array(*[levels[r["lvl"]] for r in size] or [levels[-1]])))
    pool = pool.join(_small(asked, n_asked), at).withColumn("slot", F.pmod(h(0), F.col("slots"))).filter("slot < used")
    pool = pool.groupBy(*at, "slot").agg(F.sort_array(F.collect_list(F.struct("id", "y"))).alias("donors"), F.first("copies").alias("copies"))
    pool = pool.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    asking = routes.join(_small(asked, n_asked), at).select(*own, "f", "cell", *at, "dist", "used", "copies")
    wanted = rows.filter("y is null").drop("y").join(_small(asking, n_routes), [*own, "f", "cell"], "left")
    wanted = wanted.withColumn("slot", F.pmod(h(1), F.col("used"))).withColumn("copy", F.pmod(h(3), F.col("copies")).cast("int"))
    best = wanted.join(pool, [*at, "slot", "copy"], "left").withColumn("d", F.get("donors", F.pmod(h(2), F.size("donors")).cast("int")))
    label = F.element_at(F.array(*[F.lit(f.name) for f in fields]), F.col("f") + 1)
    filled = F.col("d").isNotNull()
    return best.select(
        F.col("id").alias(key), label.alias("field_name"), F.col("d.y").alias("filled_value"), F.col("d.id").alias("donor_id"),
        F.when(filled, F.col("lvl")).alias("group_level"), F.col("p").alias("prediction"), F.when(filled, F.col("dist")).alias("donor_distance"),
        filled.alias("was_filled"),
    )


def grid(z: Column, even: int) -> Column:
    """The cell of a prediction in units of cell widths: even up to ``even``, then growing."""
    a = F.abs(z)
    far = even + F.floor(even * F.ln(a / even))
    return (F.signum(z) * F.when(a <= even, F.round(a)).otherwise(far)).cast("int")


def filled_table(df: DataFrame, key: str, fields: Sequence[Field], fills: DataFrame) -> DataFrame:
    """The table with its fields completed, and per field a mark and the donor's id."""
    wide = fills.groupBy(key).agg(
        *[F.max(F.when(F.col("field_name") == f.name, F.struct("filled_value", "donor_id"))).alias(f"__{f.name}") for f in fields]
    )
    out = df.join(wide, key, "left")
    for f in fields:
        c, fill = F.col(f.name).cast("double"), F.col(f"__{f.name}")
        out = out.withColumns(
            {
                f.name: F.when(f.legal(c), c).otherwise(fill["filled_value"]),
                f"{f.name}_filled": fill.isNotNull() & fill["filled_value"].isNotNull(),
                f"{f.name}_donor": fill["donor_id"],
            }
        ).drop(f"__{f.name}")
    return out
