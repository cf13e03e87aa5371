"""Small scalar expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def finite_or_zero(c: Column) -> Column:
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def last_token(label: Column, sep: str = "-") -> Column:
    return F.element_at(F.split(F.coalesce(label, F.lit("")), sep), -1)


def truthy(c: Column, kind: str = "string") -> Column:
    """The value, or null where it is empty or zero."""
    return F.when(c != F.lit("" if kind == "string" else 0), c)


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def stable_order(seed: int, *cols: Column) -> Column:
    """Reproducible pseudo-random sort key, the same on every engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))
