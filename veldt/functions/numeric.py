"""Numeric expressions: finite values, clamping, rounding, levels, interpolation."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EPSILON = 2.220446049250313e-16


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clamp(x: Column, low: float, high: float) -> Column:
    """x between two bounds; null stays null, though least and greatest would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def half_up(x: Column, digits: int) -> Column:
    """Round half up, by floor(x * 10**d + 0.5): half toward plus infinity for negatives too."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def half_up_eps(x: Column, digits: int) -> Column:
    """Half up after adding the double epsilon."""
    return F.floor((x + EPSILON) * float(10**digits) + 0.5) / float(10**digits)


@F.pandas_udf(DoubleType())
def exact_fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Round the exact binary value half up (away from zero), for golden comparisons."""

    def one(v, d):
        if v is None or pd.isna(v):
            return None
        return float(Decimal(v).quantize(Decimal(1).scaleb(-int(d)), ROUND_HALF_UP))

    return pd.Series([one(v, d) for v, d in zip(x, digits, strict=True)], dtype="float64")


def risk_level(score: Column) -> Column:
    """Level of a baseline score: cuts at 25, 50 and 75."""
    return F.when(score < 25, "low").when(score < 50, "medium").when(score < 75, "high").when(score.isNotNull(), "critical")


def index_level(score: Column) -> Column:
    """Level of an index: cuts at 40, 60 and 75."""
    return F.when(score >= 75, "critical").when(score >= 60, "high").when(score >= 40, "medium").when(score.isNotNull(), "low")


def tone(score: Column) -> Column:
    """Display tone: cuts at 45, 55 and 65; neutral where there is no score."""
    return (
        F.when(score.isNull(), "neutral").when(score >= 65, "critical").when(score >= 55, "high").when(score >= 45, "medium").otherwise("low")
    )


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "高").when(confidence >= 0.60, "中").otherwise("低")


def step_decay(months: Column) -> Column:
    """1, 0.7, 0.4, 0.2 for ages up to 12, 24, 36 and more months."""
    return F.when(months <= 12, 1.0).when(months <= 24, 0.7).when(months <= 36, 0.4).otherwise(0.2)


def month_gap(later: Column, earlier: Column) -> Column:
    """Calendar months between two dates, days ignored, never negative."""
    gap = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return F.greatest(gap, F.lit(0))


def spacing(start: Column, end: Column, i: Column, n: Column) -> Column:
    """The i-th (from 0) of n evenly spaced values."""
    return F.when(n <= 1, start).otherwise(start + (end - start) * i / F.greatest(n - 1, F.lit(1)))


# Colours of scores 0, 50 and 100, and of no score.
HEAT = ((34, 211, 238), (250, 204, 21), (239, 68, 68))
NO_HEAT = "#64748b"


def heat_colour(score: Column) -> Column:
    """#rrggbb between the heat colours, in two linear pieces that meet at 50; a grey where there is no score."""
    s = clamp(score, 0, 100)
    low, mid, high = HEAT

    def channel(i: int) -> Column:
        first = low[i] + (mid[i] - low[i]) * s / 50
        second = mid[i] + (high[i] - mid[i]) * (s - 50) / 50
        return F.lower(F.lpad(F.hex(F.floor(F.when(s <= 50, first).otherwise(second) + 0.5).cast("long")), 2, "0"))

    return F.coalesce(F.concat(F.lit("#"), channel(0), channel(1), channel(2)), F.lit(NO_HEAT))


def polar(radius: Column, index: Column, count: int) -> tuple[Column, Column]:
    """x, y (2 decimals) of the index-th of `count` axes, the first pointing up."""
    angle = index * (2 * 3.141592653589793 / count) - 3.141592653589793 / 2
    return half_up(radius * F.cos(angle), 2), half_up(radius * F.sin(angle), 2)
