"""Fitted models through pyspark.ml, with the penalties in their usual textbook form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.windows import exact_quantiles


def standardised(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features filled by their medians and scaled by population deviations, as one vector column."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "x")
    found = exact_quantiles(long, "x", [0.5], ["feature"])
    stats = found.agg(*[F.max(F.when(F.col("feature") == c, F.col("q0"))).alias(f"d_{c}") for c in features])
    filled = rows.join(F.broadcast(stats)).select(*rows.columns, *[F.coalesce(F.col(c).cast("double"), F.col(f"d_{c}"), F.lit(0.0)).alias(f"f_{c}") for c in features])
    scale = filled.agg(*[F.avg(f"f_{c}").alias(f"m_{c}") for c in features], *[F.stddev_pop(f"f_{c}").alias(f"s_{c}") for c in features])
    z = [F.coalesce(F.try_divide(F.col(f"f_{c}") - F.col(f"m_{c}"), F.nullif(F.col(f"s_{c}"), F.lit(0.0))), F.lit(0.0)).alias(f"z_{c}") for c in features]
    out = filled.join(F.broadcast(scale)).select(*rows.columns, *z)
    return VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="features").transform(out).drop(*[f"z_{c}" for c in features])


def balanced_logistic(rows: DataFrame, features: Sequence[str], label: str, c: float = 0.5):
    """Logistic regression with inverse penalty c and classes of equal total weight; the model and its inputs."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # two classes
    n = sum(counts.values())
    weight = F.element_at(F.create_map(*[F.lit(x) for k, v in counts.items() for x in (int(k), n / (len(counts) * v))]), F.col(label).cast("int"))
    data = standardised(rows, features).withColumn("_weight", weight).withColumn("_label", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="features", labelCol="_label", weightCol="_weight", regParam=1 / (c * n), standardization=False, maxIter=200, tol=1e-9).fit(data)
    return model, data


def penalised_line(rows: DataFrame, features: Sequence[str], label: str, alpha: float, l1_share: float = 0.0):
    """Elastic net; alpha is the penalty of 1/(2n) squared error, as in coordinate descent."""
    data = standardised(rows, features).withColumn("_label", F.col(label).cast("double"))
    spread = data.agg(F.stddev_samp("_label")).first()[0] or 1.0
    one, two = alpha * l1_share, alpha * (1 - l1_share) * spread  # the library scales only the squared penalty by the spread
    model = LinearRegression(featuresCol="features", labelCol="_label", regParam=one + two, elasticNetParam=one / (one + two) if one + two else 0.0, standardization=False, solver="l-bfgs", maxIter=500, tol=1e-9).fit(data)
    return model, data
