"""Money is integer paise; decimal rupee text is converted once, on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_paise(rupees: Column) -> Column:
    """Decimal rupee text to paise, halves away from zero; absent is 0."""
    exact = F.round(rupees.try_cast("decimal(30,8)") * 100, 0).cast("long")
    return F.when(rupees.isNull() | (rupees == ""), F.lit(0).cast("long")).otherwise(exact)


def money(paise: Column, rupees: Column) -> Column:
    """A paise value wins over the rupee spelling of the same amount."""
    return F.coalesce(paise.try_cast("long"), to_paise(rupees.cast("string")))
