"""Rounding as the scores are defined: half goes up, on the binary product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 3) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp01(x: Column) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
