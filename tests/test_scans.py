"""Scans of folders: what reaches the files, columns that some lack, live rows over history."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import archive, events

SCHEMA = "player_id long, a int, b string, _season int, _season_type string"


def _plan(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i % 5, i, f"b{i}", 2000 + i % 4, ("rg", "po", "pre")[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.filter("_season < 2002").drop("b").withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/x/part=0")
    df.filter("_season >= 2002").write.parquet(f"{tmp_path}/x/part=1")
    return f"{tmp_path}/x", rows


def test_files_with_other_columns_are_one_table(spark, folder):
    path, rows = folder
    got = events.scan_events(spark, path, SCHEMA)
    assert got.columns == ["player_id", "a", "b", "_season", "_season_type"]
    assert {tuple(r) for r in got.collect()} == {(p, a, b if s >= 2002 else None, s, k) for p, a, b, s, k in rows}
    with pytest.raises(ValueError, match="lacks the columns c"):
        events.scan_events(spark, path, SCHEMA + ", c string")
    assert events.scan_events(spark, path, SCHEMA + ", c string", optional=["c"]).filter("c is null").count() == 60
    with pytest.raises(ValueError, match="nothing at"):
        events.scan_events(spark, path + "-not", SCHEMA)


@pytest.mark.parametrize("keys", ["list", "table", "long list"])
def test_three_filters_reach_the_files(spark, folder, keys, monkeypatch):
    path, rows = folder
    if keys == "long list":
        monkeypatch.setattr(events, "LISTED", 1)
    given = spark.createDataFrame([(1,), (3,), (3,)], "who long") if keys == "table" else [1, 3]
    got = events.scan_events(spark, path, SCHEMA, first=2001, last=2002, types=["rg", "po"], keys=given)
    assert sorted(r["a"] for r in got.collect()) == sorted(a for p, a, _, s, k in rows if 2001 <= s <= 2002 and k != "pre" and p in (1, 3))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", _plan(spark, got)).group(1)
    assert "GreaterThanOrEqual(_season,2001)" in pushed and "LessThanOrEqual(_season,2002)" in pushed and "In(_season_type" in pushed
    assert ("player_id" in pushed and "In(player_id" in pushed) == (keys == "list")


def test_partition_folders_outside_the_range_are_not_read(spark, tmp_path):
    rows = [("2013-14", "regular", 20000001, 1, "2013-11-01", 1), ("2019-20", "regular", 20000001, 1, "2019-11-01", 2), ("2019-20", "regular", 20000001, 1, "2019-11-02", 3), ("2019-20", "unknown", 20000005, 1, "2019-11-02", 4), ("2019-20", "unknown", 40000005, 1, "2019-11-02", 5), ("2019-20", "playoffs", 20000006, 1, "2019-11-02", 6)]
    path = f"{tmp_path}/games"
    archive.write_partitions(spark.createDataFrame(rows, "season string, season_type string, game_id long, team_id long, game_date string, k int"), path)
    got = events.load_team_games(spark, path)
    assert {(r["k"], r["stored_season_type"]) for r in got.collect()} == {(3, "regular"), (4, "unknown")}
    plan = _plan(spark, got)
    assert re.search(r"PartitionFilters: \[[^\]]*season[^\]]*>= 2014-15", plan)
    with pytest.raises(ValueError, match="no seasons"):
        events.load_team_games(spark, path, first="2030-31")


def test_live_rows_replace_their_keys(spark):
    history = spark.createDataFrame([("s", 1, 5, 7), ("s", 2, 6, 8), ("s", None, 1, 1)], "season string, player_id long, x int, y int")
    live = spark.createDataFrame([("s", 2, 9), ("s", 2, 10), ("t", 3, 4)], "season string, player_id long, x int")
    got = {tuple(r) for r in events.live_over_history(history, live, ["season", "player_id"]).collect()}
    assert got == {("s", 1, 5, 7), ("s", None, 1, 1), ("s", 2, 10, None), ("t", 3, 4, None)}
    impact = spark.createDataFrame([("s", 1, 1.0, 1), ("s", 1, 2.0, 2)], "season string, player_id long, dpm double, updated int")
    out = {r["player_id"]: r["dpm"] for r in events.player_seasons(history, None, impact).collect()}
    assert out == {1: 2.0, 2: None, None: None}
