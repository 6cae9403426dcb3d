"""Curves that turn a raw metric into 0-100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(raw: Column, worst: float, best: float) -> Column:
    """0 at worst, 100 at best, clamped; pass worst > best for lower-is-better. Null stays null."""
    if worst == best:
        return F.lit(100.0)
    share = (raw - F.lit(float(worst))) / F.lit(float(best) - float(worst)) * 100.0
    return clamp(share)


def clamp(value: Column) -> Column:
    """Into 0..100. Null stays null: least and greatest alone would skip it."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def mean_observed(*parts: Column) -> Column:
    """Mean of the non-null parts; 0 when none was observed."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    seen = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(seen > 0, total / seen).otherwise(0.0)


def py_round(value: Column, digits: int = 1) -> Column:
    """Half-even rounding, as score values are stored."""
    return F.bround(value, digits)
