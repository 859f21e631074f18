"""Measures of models: ranking, calibration, errors, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.windows import cumulative, exact_quantiles, percentile_table


def ranking_quality(rows: DataFrame, score: str, label: str) -> DataFrame:
    """roc_auc and average_precision over distinct thresholds, from running counts of all rows and of the positives."""
    both = rows.select((-F.col(score).cast("double")).alias("s"), F.col(label).cast("double").alias("p"))
    per = both.groupBy("s").agg(F.sum("p").alias("p"), F.count("*").alias("c"))
    everything = cumulative(both, "s").select(F.col("v").alias("s"), F.col("upto").alias("all"))
    found = cumulative(both.filter("p > 0"), "s").select(F.col("v").alias("s"), F.col("upto").alias("tp"))
    cum = per.join(everything, "s").join(found, "s", "left")
    precision = cum.filter("p > 0").agg((F.sum(F.col("p") * F.col("tp") / F.col("all"))).alias("_gain"), F.sum("p").alias("_p"))
    # Each positive beats the negatives below it and half of those level with it.
    total = per.agg((F.sum("c") - F.sum("p")).alias("negatives"))
    wins = cum.filter("p > 0").join(F.broadcast(total)).select("p", "negatives", (F.col("all") - F.col("tp")).alias("not_below"), (F.col("c") - F.col("p")).alias("level"))
    roc = wins.agg(F.sum(F.col("p") * (F.col("negatives") - F.col("not_below") + F.col("level") / 2)).alias("_wins"), F.sum("p").alias("_positives"), F.max("negatives").alias("_negatives"))
    out = roc.join(F.broadcast(precision))  # a row each
    return out.select(F.try_divide("_wins", F.nullif(F.col("_positives") * F.col("_negatives"), F.lit(0.0))).alias("roc_auc"), F.try_divide("_gain", F.nullif(F.col("_p"), F.lit(0.0))).alias("average_precision"))


def precision_at(rows: DataFrame, score: str, label: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(n).agg(F.avg(F.col(label).cast("double")).alias("precision"))


def regression_errors(rows: DataFrame, actual: str, predicted: str, quantile: float = 0.8) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    errors = rows.select(e.alias("e"), F.abs(e).alias("size"))
    of = errors.agg(F.avg("size").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.stddev_samp("e").alias("error_deviation"))
    at = exact_quantiles(errors, "size", [quantile]).withColumnRenamed("q0", "error_quantile")
    return of.join(F.broadcast(at)).select("mae", "rmse", "error_quantile", "error_deviation")  # a row each


def rank_correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman: the correlation of average ranks."""
    ra = percentile_table(rows, a).select(F.col("v").alias(a), F.col("pct").alias("_ra"))
    rb = percentile_table(rows, b).select(F.col("v").alias(b), F.col("pct").alias("_rb"))
    return rows.join(ra, a).join(rb, b).agg(F.corr("_ra", "_rb").alias("rank_correlation"))


def non_negative_line(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares with a slope of 0 or more; the mean where it would be below."""
    fit = rows.agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.avg(y).alias("m"))
    return fit.select(F.greatest(F.lit(0.0), "s").alias("slope"), F.when(F.col("s") > 0, F.col("i")).otherwise(F.col("m")).alias("intercept"))


def quantiles(rows: DataFrame, value: str, at: Sequence[float], above: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact quantiles, and shares above thresholds; weight is how often a row counts."""
    w = F.lit(1) if weight is None else F.col(weight)
    found = exact_quantiles(rows, value, at, weight=weight).select(*[F.col(f"q{i}").alias(f"q{int(q * 100)}") for i, q in enumerate(at)])
    if not above:
        return found
    shares = rows.agg(*[F.try_divide(F.sum(F.when(F.col(value) > t, w).otherwise(0)), F.sum(w)).alias(f"above_{int(t * 100)}") for t in above])
    return found.join(F.broadcast(shares))  # a row each


def jaccard_at(first: DataFrame, second: DataFrame, query: str, item: str, by: Sequence[str] = ()) -> DataFrame:
    """Overlap of two neighbour lists of each query; of each value of `by` too."""
    both = first.select(*by, query, item, F.lit(1).alias("_a")).join(second.select(*by, query, item, F.lit(1).alias("_b")), [*by, query, item], "full")
    return both.groupBy(*by, query).agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*")).alias("jaccard"))


def bins(value: Column, edges: Sequence[float]) -> Column:
    """Number of the right-closed bin (0 for values up to the first edge)."""
    return sum((F.when(value > e, 1).otherwise(0) for e in edges[1:]), F.when(value > edges[0], 1).otherwise(0))
