"""Aggregates and arithmetic that keep NULL apart from 0."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL where b is 0."""
    return F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double"))


def mean(x: Column) -> Column:
    """Exact for integers: the sum is divided once."""
    return ratio(F.sum(x), F.count(x))


def count_true(b: Column) -> Column:
    return F.count_if(F.coalesce(b, F.lit(False)))


def pooled_rate(b: Column, among: Column) -> Column:
    return ratio(count_true(b), F.count(among))


def weighted_mean(x: Column, n: Column) -> Column:
    """Sum of x * n over the sum of n where x was measured."""
    return ratio(F.sum(x * n), F.sum(F.when(x.isNotNull(), n)))


def sum_where(x: Column, cond: Column) -> Column:
    return F.sum(F.when(cond, x))


def exposure_rate(events: Column, exposed: Column, per: int = 100) -> Column:
    """Events per so many exposed, where events were measured."""
    return ratio(F.lit(per) * F.sum(events), sum_where(exposed, events.isNotNull()))


def percentile(x: Column, p: float) -> Column:
    """Interpolated and exact."""
    return F.percentile(x, F.lit(p))


def delta_percent(v: Column, base: Column) -> Column:
    return F.try_divide((v - base).cast("double"), F.nullif(base, F.lit(0)).cast("double")) * 100


def delta_percent_panel(v: Column, base: Column) -> Column:
    """As delta_percent, but rates between 0 and 1 are taken as percentages first."""
    up = lambda x: F.when((x > 0) & (x < 1), x * 100).otherwise(x)
    return delta_percent(up(v), up(base))


def safe_normalize(v: Column, low: Column, high: Column) -> Column:
    """Place in [0, 1]; 0.5 where the range has no width or anything is missing."""
    t = F.try_divide((v - low).cast("double"), F.nullif(high - low, F.lit(0)).cast("double"))
    return F.when(t.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def risk_intensity(risky: Column, red: Column, pooled: Column) -> Column:
    return F.coalesce((risky + red) / F.lit(2.0), pooled)


def rounded(x: Column, digits: int) -> Column:
    """To so many digits, halves up, as double: the same arithmetic in every engine."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5).cast("double") / scale
