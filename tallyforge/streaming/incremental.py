"""Totals kept up to date from a stream of new files: partials per batch, merged when read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators.aggregate import finish, merge_partials, partials


def follow(source: DataFrame, keys: Sequence[str], sums: Sequence[str], observed: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write the partials of each new batch to path/batch=<id>; a batch that is run again replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        partials(batch, keys, sums, observed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str], observed: str) -> DataFrame:
    """The merged totals of all batches so far."""
    parts = spark.read.parquet(path).drop("batch")
    return finish(merge_partials(parts, keys), sums, observed)


def windowed_counts(source: DataFrame, time: str, kind: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by kind and time window of a stream, with rows later than `late` left out."""
    return source.withWatermark(time, late).groupBy(F.window(time, every), kind).agg(F.count("*").alias("events"))
