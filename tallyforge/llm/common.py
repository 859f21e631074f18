"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Only for a local master without a named folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints/tallyforge"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    On a cluster it has to be named; a local master, whose tasks run on the driver's machine, has a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not named:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = LOCAL_DIR
    return named.rstrip("/")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """names, with as many underscores before them as it takes to be none of `taken` (case doesn't tell names apart)."""
    low, mark = {c.lower() for c in taken}, "_"
    while any(mark + n in low for n in names):
        mark += "_"
    return [mark + n for n in names]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    Cuts lineage: a lost executor costs a reread of the files and never a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "1m", rows: int = 512) -> Iterator[None]:
    """Jobs that are started within hand rows to Python in batches of about so many bytes, and decode so many rows at once.

    Spark's own limits are 10,000 and 4096 rows, which of whole texts stand in memory several times: in the arrays of the
    reader, in Arrow's buffers of the JVM and of Python, and as Python's strings; both processes keep what they once took.
    Only jobs that run before the end are bound, not those of a frame that is returned.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def give_back() -> None:
    """Hand to the system what Arrow keeps of freed batches; else a worker holds it while it waits for its next task."""
    pa.default_memory_pool().release_unused()


def discard(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Delete the files of materialized frames that nothing reads any more, and of shuffles that are done.

    Spark removes the files of a shuffle when the driver collects the garbage that refers to it, which a driver with
    memory to spare seldom does by itself; so it is asked to.
    """
    for df in frames:
        for file in df.inputFiles()[:1] if df is not None else []:
            folder = file.rpartition("/")[0]
            if re.search(r"/[\w-]+-[0-9a-f]{32}$", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return True


def row_hash(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of all columns of a row; equal rows have equal hashes."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    nulls = [c.isNull() for c in cols]  # a null leaves the running hash as it is
    return F.xxhash64(F.lit(seed), *cols, *nulls)


def join_skewed(
    rows: DataFrame, counted: DataFrame, key: str, count: str, total: int, hot_share: int = 1000, how: str = "inner"
) -> DataFrame:
    """Join rows to a table with one row per key, where some keys hold a large share of the rows.

    counted has the columns key, count (how many of `total` rows have the key) and more. Keys with at
    least total / hot_share rows are at most hot_share in number, whatever the input; only those are
    broadcast, and their rows stay where they are. The rows of all other keys are joined by shuffle, and none of those keys
    has more than that share. rows is read twice, so it should be a written table. A null key meets nothing.
    """
    least = max(2, total // hot_share)
    more = [c for c in counted.columns if c != key]
    hot, cold = counted.filter(F.col(count) >= least), counted.filter(F.col(count) < least)
    cols = [F.col(f"`{c}`") for c in [*rows.columns, *more]]
    of_hot = rows.join(F.broadcast(hot), key).select(*cols)
    of_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how).select(*cols)
    return of_hot.unionByName(of_cold)
