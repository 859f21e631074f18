"""Vector arithmetic on array<double> columns, inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def once(value: Column, use) -> Column:
    """use(value), in which value is worked out once a row, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column) -> Column:
    return once(a, lambda v: once(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x, F.nullif(n, F.lit(0.0))))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def angular(cos: Column) -> Column:
    """1 for the same direction, 0 for the opposite one."""
    return F.lit(1.0) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / F.lit(math.pi)


def joined(a: Column, b: Column, share: float) -> Column:
    """One vector whose dot products are the weighted mean of both parts' (share for the second)."""
    return F.concat(F.transform(a, lambda x: x * F.lit(math.sqrt(1 - share))), F.transform(b, lambda x: x * F.lit(math.sqrt(share))))


def pad(v: Column, size: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), size - F.size(v)))


def dense(columns: list[Column]) -> Column:
    return F.array(*[c.cast("double") for c in columns])
