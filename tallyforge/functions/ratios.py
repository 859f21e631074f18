"""Ratios and box-score formulas. NaN and infinities are nulls; a zero denominator gives null or a stated value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as a double, null where it is NaN or infinite."""
    d = x.cast("double")
    return F.when(F.abs(d) < float("inf"), d)


def exact_sum(x: Column) -> Column:
    """The sum of doubles of up to eight decimals, the same in whatever order they come; larger than 1e20 or finer ones are added as doubles."""
    exact = x.try_cast("decimal(38,8)")
    fits = (F.abs(x) < 1e20) & (exact.cast("double") == x)
    return F.when(F.coalesce(F.bool_and(fits), F.lit(True)), F.sum(F.when(fits, exact)).cast("double")).otherwise(F.sum(x))


def scaled_round(x: Column, digits: int) -> Column:
    """x rounded as the SQL's round_even does it: the product with a power of ten goes to the nearest integer, halves to even ones."""
    return F.rint(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def ratio(numerator: Column, denominator: Column, on_zero: float | None = None) -> Column:
    out = F.try_divide(finite(numerator), F.nullif(finite(denominator), F.lit(0.0)))
    return out if on_zero is None else F.coalesce(out, F.lit(float(on_zero)))


def effective_rate(made: Column, made_long: Column, tried: Column, on_zero: float | None = 0.0) -> Column:
    """Makes with a half more for long ones, per try."""
    return ratio(made + F.lit(0.5) * made_long, tried, on_zero)


def true_rate(points: Column, tried: Column, free: Column, on_zero: float | None = 0.0) -> Column:
    """Points per two used chances; a free throw uses 0.44 of one."""
    return ratio(points, F.lit(2.0) * (tried + F.lit(0.44) * free), on_zero)


def per_minutes(total: Column, minutes: Column, base: float = 36.0) -> Column:
    return ratio(F.lit(base) * total, minutes)


def used_chances(tried: Column, free: Column, lost: Column) -> Column:
    return tried + F.lit(0.44) * free + lost


def possessions(tried: Column, offensive_rebounds: Column, lost: Column, free: Column) -> Column:
    return tried - offensive_rebounds + lost + F.lit(0.44) * free


def shrink(value: Column, weight: Column, prior: Column, strength: float) -> Column:
    """Value pulled towards a prior as if `strength` more observations had it."""
    return (value * weight + prior * F.lit(float(strength))) / (weight + F.lit(float(strength)))


def logistic(x: Column, scale: float = 2.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x / F.lit(scale)))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))
