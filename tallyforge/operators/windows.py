"""Ranks, standard scores, fills and choices within groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.scratch import kept


#: Distinct values that one task orders, about, and the most ranges that values are cut into.
RANGE_VALUES, MOST_RANGES = 200_000, 1024


def on_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, one row for each value of keys; nulls are a value. Without keys, right has one row."""
    if not keys:
        return left.join(F.broadcast(right))
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(right, reduce(lambda a, b: a & b, same), how).drop(*[f"_of_{k}" for k in keys])


def cumulative(df: DataFrame, value: str, group: Sequence[str] = (), ranges: int | None = None, weight: str | None = None) -> DataFrame:
    """Each distinct value v of each group with n (its rows, or their weights), upto (rows up to it, its own included) and total.

    Values are counted first. Ranges of values are then cut at approximate quantiles, as many as the counted values need: a running
    count inside each range and the sums of the ranges before make the running count of the group, so no task holds a group and nothing
    goes to the driver. Values that one task can order are one range. The cuts are written once, for they hang on the order in which parts are
    merged, and both uses need the same ones.
    """
    v = F.col(value).cast("double")
    size = F.count("*") if weight is None else F.sum(weight)
    counts = kept(df.filter(v.isNotNull()).groupBy(*group, v.alias("v")).agg(size.alias("n")), "value-counts")
    ranges = ranges or min(MOST_RANGES, -(-counts.count() // RANGE_VALUES))
    if ranges <= 1:
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("v")
        run = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return run.withColumn("total", F.sum("n").over(Window.partitionBy(*(group or [F.lit(0)])))).select(*group, "v", "n", "total", "upto")
    edges = kept(counts.groupBy(*group).agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], max(1000, 10 * ranges)).alias("_edges"), F.sum("n").alias("total")), "range-edges")
    placed = on_group(counts, edges, group).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("v")))).drop("_edges")
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy(*group, "_range").agg(F.sum("n").alias("_sum")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    inside = F.sum("n").over(Window.partitionBy(*group, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return on_group(placed, sums, [*group, "_range"]).withColumn("upto", inside + F.col("_before")).drop("_range", "_before")


def percentile_table(df: DataFrame, value: str, higher_is_better: bool = True, group: Sequence[str] = ()) -> DataFrame:
    """Each distinct value v of each group with pct: rank over the number of values, ties sharing their mean rank."""
    rank = F.col("upto") - F.col("n") if higher_is_better else F.col("total") - F.col("upto")
    return cumulative(df, value, group).select(*group, "v", ((rank + (F.col("n") + 1) / 2) / F.col("total")).alias("pct"))


def percentiles(df: DataFrame, key: Sequence[str], columns: dict[str, bool], group: Sequence[str] = (), missing: float = 0.5, prefix: str = "pct_") -> DataFrame:
    """df (one row a key) with the percentile of each column in its group, `missing` for null; False ranks high values low.

    All columns are ranked at once in long form.
    """
    df = kept(df, "to-rank")
    long = df.select(*key, *[c for c in group if c not in key], *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([*key, *[c for c in group if c not in key]], list(columns), "feature", "_x")
    high = F.array(*[F.lit(c) for c, up in columns.items() if up])
    table = cumulative(long, "_x", [*group, "feature"])
    rank = F.when(F.array_contains(high, F.col("feature")), F.col("upto") - F.col("n")).otherwise(F.col("total") - F.col("upto"))
    table = table.select(*group, "feature", F.col("v").alias("_x"), ((rank + (F.col("n") + 1) / 2) / F.col("total")).alias("pct"))
    ranked = on_group(long.filter("_x is not null"), table, [*group, "feature", "_x"])
    wide = ranked.groupBy(*key).agg(*[F.max(F.when(F.col("feature") == c, F.col("pct"))).alias(f"{prefix}{c}") for c in columns])
    return df.join(wide, list(key), "left").fillna(missing, [f"{prefix}{c}" for c in columns])


def exact_quantiles(df: DataFrame, value: str, at: Sequence[float], group: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Interpolated quantiles q0, q1, ... of each group from counted values; weight is how often a row counts."""
    run = cumulative(df, value, group, weight=weight)
    low, high = F.col("upto") - F.col("n"), F.col("upto")
    place = [F.lit(float(q)) * (F.col("total") - 1) for q in at]
    held = lambda k: F.max(F.when((low <= k) & (k < high), F.col("v")))
    found = run.groupBy(*group).agg(
        F.max("total").alias("_total"), *[held(F.floor(k)).alias(f"_lo{i}") for i, k in enumerate(place)], *[held(F.least(F.floor(k) + 1, F.col("total") - 1)).alias(f"_hi{i}") for i, k in enumerate(place)]
    )
    part = [F.lit(float(q)) * (F.col("_total") - 1) - F.floor(F.lit(float(q)) * (F.col("_total") - 1)) for q in at]
    return found.select(*group, *[(F.col(f"_lo{i}") + part[i] * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}") for i in range(len(at))])


def fill_median(df: DataFrame, value: str, group: Sequence[str], into: str) -> DataFrame:
    """Null values get their group's median, or 0 where the group has no value."""
    medians = exact_quantiles(df, value, [0.5], group).withColumnRenamed("q0", "_median")
    return on_group(df, medians, group, "left").withColumn(into, F.coalesce(F.col(value), "_median", F.lit(0.0))).drop("_median")


def pick(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).filter(F.col(rank or "_rank") <= n)
    return out if rank else out.drop("_rank")


def islands(df: DataFrame, group: Sequence[str], order: Sequence[Column], starts: Column, into: str = "sequence") -> DataFrame:
    """Numbers the runs of rows that begin where `starts` is true."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(into, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def halves(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """half (1: the rows before the middle, 2) and parity (1: odd places, 0) of each row."""
    g = Window.partitionBy(*group)
    place = F.row_number().over(g.orderBy(*order))
    return df.withColumn("_p", place).withColumn("half", F.when((F.col("_p") - 1) < F.count("*").over(g) / 2, 1).otherwise(2)).withColumn("parity", F.col("_p") % 2).drop("_p")


def capped(df: DataFrame, bucket: str, order: Sequence[Column], most: int, n: int) -> DataFrame:
    """The first n rows of which no bucket has more than `most`."""
    return pick(df, [bucket], order, most).orderBy(*order).limit(n)


def midrank(values: DataFrame, value: str, pool: DataFrame, pool_value: str, group: str) -> DataFrame:
    """Place of each value among its group's pool: the mean of the shares below and up to it, shifted by half a row;
    null where the pool is empty.

    Values and pool are laid on one line a group, so no pair of rows is made.
    """
    line = values.select("*", F.col(value).alias("_v"), F.lit(0).alias("_pool")).unionByName(pool.select(F.col(group), F.col(pool_value).alias("_v"), F.lit(1).alias("_pool")), allowMissingColumns=True)
    g = Window.partitionBy(group).orderBy("_v")
    upto = F.sum("_pool").over(g.rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum("_pool").over(Window.partitionBy(group, "_v"))
    n = F.sum("_pool").over(Window.partitionBy(group))
    out = line.withColumn("midrank", F.try_divide(upto - same + upto + 1, 2 * n))
    return out.filter("_pool = 0").drop("_v", "_pool")
