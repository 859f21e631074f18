"""Folders that driver and executors share, for tables that several steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; a local master may have one of its own."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not named and not (conf.get("spark.master", "").startswith("local[") or conf.get("spark.master", "") == "local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{(named or '/tmp/checkpoints/tallyforge').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read back: what reads it twice doesn't compute it twice, and a lost executor costs a reread."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
