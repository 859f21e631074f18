"""One session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip(f"no tables in {SF}")
    return SF


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v) + 0.0:.8g}"  # -0.0 is 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v if v is None or isinstance(v, (int, str)) else str(v)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql():
    """same_as_sql(df, sql, folder): equal column names, and equal rows in any order."""

    def compare(df, sql: str, folder: str) -> None:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for path in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        assert _sorted(df.columns, df.collect()) == _sorted(names, found.fetchall())

    return compare
