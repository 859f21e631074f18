"""The registry of queries over the supplied tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def rounded(df, keys, digits=9):
    """keys as they are, other columns with doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys])
