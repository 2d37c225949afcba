"""Code recoding and null-aware row-wise expressions; all are plain Columns.

Missing is NULL throughout. NaN counts as missing and never leaves these functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that mean missing unless a column's rule names others.
MISSING = (7.0, 8.0, 9.0, 97.0, 98.0, 99.0)
HIGH_MISSING = (97.0, 98.0, 99.0)


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: str | Column) -> Column:
    """Lenient cast to double; text that is no number, and NaN, become null."""
    return F.nanvl(as_col(c).try_cast("double"), F.lit(None).cast("double"))


def valid(c: str | Column, ok: Sequence[float] | None = None, bad: Sequence[float] = MISSING) -> Column:
    """Null the missing codes first, then everything outside the legal codes."""
    x = numeric(c)
    keep = ~x.isin(*map(float, bad)) if bad else x.isNotNull()
    return F.when(keep & (x.isin(*map(float, ok)) if ok else F.lit(True)), x)


def yes_no(c: str | Column) -> Column:
    """1 is 1, 2 is 0, all else null."""
    x = numeric(c)
    return F.when(x == 1, 1.0).when(x == 2, 0.0)


def code_map(c: Column, values: Mapping[float, float]) -> Column:
    """Value of a code; unmapped codes become null."""
    pairs = iter(values.items())
    k, v = next(pairs)
    out = F.when(c == float(k), float(v))
    for k, v in pairs:
        out = out.when(c == float(k), float(v))
    return out


def code_label(c: str | Column, labels: Mapping[int, str], strict: bool = False) -> Column:
    """Label of a code; an unmapped code gives ``code n``, or null if strict."""
    x = numeric(c)
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(x == float(k), v).otherwise(out)
    return out if strict else F.when(x.isNotNull(), F.coalesce(out, F.concat(F.lit("code "), x.cast("long").cast("string"))))


def target(c: str | Column) -> Column:
    return yes_no(c).cast("int")


def band(x: Column, edges: Sequence[float], values: Sequence) -> Column:
    """Value of the half-open band [edge i-1, edge i); null stays null. One value more than edges."""
    out = F.when(x < float(edges[0]), F.lit(values[0]))
    for e, v in zip(edges[1:], values[1:]):
        out = out.when(x < float(e), F.lit(v))
    return out.when(x >= float(edges[-1]), F.lit(values[-1]))


def band_label(x: Column, edges: Sequence[int]) -> Column:
    names = [f"<{edges[0]}", *[f"{a}-{b}" for a, b in zip(edges, edges[1:])], f">={edges[-1]}"]
    return band(x, edges, names)


def row_max(*cols: Column) -> Column:
    """Largest non-null value, null if all are null."""
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def row_sum(*cols: Column) -> Column:
    """Sum of the non-null values, null if all are null."""
    return F.when(F.coalesce(*cols).isNotNull(), reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) for c in cols]))


def row_count(*cols: Column) -> Column:
    return reduce(Column.__add__, [c.isNotNull().cast("int") for c in cols])


def row_mean(*cols: Column) -> Column:
    """Mean of the non-null values, null if all are null."""
    return F.try_divide(row_sum(*cols), row_count(*cols))


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """Limit to [lo, hi]; null stays null (greatest would turn it into lo)."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def weighted_available(parts: Mapping[str, tuple[Column, float]]) -> tuple[Column, Column, Column]:
    """Weighted mean over the available parts, their number, and the share of weight they have."""
    top = row_sum(*[c * w for c, w in parts.values()])
    weight = reduce(Column.__add__, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()])
    total = float(sum(w for _, w in parts.values()))
    return F.try_divide(top, weight), row_count(*[c for c, _ in parts.values()]), weight / total


def strength(n: Column, strong: int, moderate: int) -> Column:
    return F.when(n >= strong, "strong").when(n >= moderate, "moderate").when(n >= 1, "weak").otherwise("none")


def logit(p: Column, eps: float = 1e-5) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column, limit: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -limit, limit)))


def inverse_softplus(x: Column) -> Column:
    return F.log(F.expm1(F.greatest(x, F.lit(1e-6))))


def log_loss(y: Column, p: Column, eps: float = 1e-6) -> Column:
    """Log loss of a row, p in 0 to 1."""
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))
