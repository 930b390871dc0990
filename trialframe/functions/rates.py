"""Rates: one decimal, half up, and null where nothing was counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate(num: Column | str, den: Column | str) -> Column:
    """M1: 100 * num / den to one decimal, half up, by integers only; null for an empty denominator; an error for num < 0 or num > den."""
    num, den = col(num).cast("long"), col(den).cast("long")
    tenths = F.floor((2000 * num + den) / (2 * den))
    bad = (num < 0) | (num > den)
    return F.when(bad, F.raise_error(F.lit("a rate needs 0 <= num <= den")).cast("double")).when(den == 0, None).otherwise(tenths / F.lit(10.0))


def rate_text(num: Column | str, den: Column | str) -> Column:
    """K9: "24.2% (29/120)", or "not available"."""
    num, den = col(num).cast("long"), col(den).cast("long")
    return F.when(rate(num, den).isNull(), "not available").otherwise(F.format_string("%.1f%% (%d/%d)", rate(num, den), num, den))


def band(percent: Column | str) -> Column:
    """High from 80, medium from 50, else low; null apart."""
    p = col(percent)
    return F.when(p.isNull(), "none").when(p >= 80, "high").when(p >= 50, "medium").otherwise("low")


def maintainability(index: Column | str) -> Column:
    """Band of a maintainability index; -1 is unavailable."""
    i = col(index)
    return F.when(i == -1, "Unavailable").when(i >= 80, "Excellent").when(i >= 65, "Good").when(i >= 20, "Moderate").otherwise("Low")
