"""Queries that read directories written from the tables: files whose columns differ, live rows over history, repaired types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.base import query, read
from tallyforge.plans.base import rounded as _rounded
from tallyforge.sources import archive, events
from tallyforge.sources.schema import ACTIONS, SHOTS

_ACTIONS = """WITH a AS (SELECT event_type AS "actionType", CASE WHEN event_id % 4 > 0 THEN 's' || event_id % 5 END AS "subType", CASE WHEN event_id % 4 > 0 THEN NULL ELSE user_id + 1 END AS assist, user_id AS "personId", event_id AS "orderNumber", 2019 + event_id % 4 AS _season, CASE WHEN event_id % 6 = 0 THEN 'po' WHEN event_id % 6 = 1 THEN 'pre' ELSE 'rg' END AS _season_type FROM events)"""


def _written_actions(spark, sf):
    """A folder of files: the first season's lack two columns, later ones have one more."""
    k, path = F.col("event_id"), archive.scratch(spark, "actions")
    kind = F.when(k % 6 == 0, "po").when(k % 6 == 1, "pre").otherwise("rg")
    rows = read(spark, sf, "events").select(
        F.col("event_type").alias("actionType"), F.when(k % 4 > 0, F.concat(F.lit("s"), (k % 5).cast("string"))).alias("subType"), F.lit(None).cast("string").alias("qualifiers"), F.col("user_id").alias("personId"),
        F.when(k % 4 == 0, (F.col("user_id") + 1).cast("double")).alias("assistPersonId"), (k % 90).alias("possession"), k.alias("orderNumber"), F.lit("PT01M").alias("clock"), (k % 4 + 1).cast("int").alias("period"), (k % 500).alias("gameId"),
        F.lit("Made").alias("shotResult"), (2019 + k % 4).cast("int").alias("_season"), kind.alias("_season_type"),
    )
    for part, df in enumerate([rows.filter("_season = 2019").drop("subType", "assistPersonId"), rows.filter("_season in (2020, 2021)").withColumn("extra", F.lit(1)), rows.filter("_season = 2022")]):
        df.write.parquet(f"{path}/part={part}")
    return path


@query("event_scan", _ACTIONS + """ SELECT _season, _season_type, "actionType", count(*) AS n, count("subType") FILTER (_season > 2019) AS sub_types, count(assist) FILTER (_season > 2019) AS assists, sum("personId")::BIGINT AS persons FROM a WHERE _season BETWEEN 2019 AND 2021 AND _season_type IN ('rg', 'po') AND "personId" IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 1) GROUP BY 1, 2, 3""")
def event_scan(spark, sf):
    people = read(spark, sf, "customer").filter("c_custkey % 3 = 1").select("c_custkey")
    rows = events.scan_events(spark, _written_actions(spark, sf), ACTIONS, first=2019, last=2021, types=["rg", "po"], keys=people, key="personId")
    return rows.groupBy(F.col("_season").cast("long").alias("_season"), "_season_type", "actionType").agg(F.count("*").alias("n"), F.count("subType").alias("sub_types"), F.count("assistPersonId").alias("assists"), F.sum("personId").alias("persons"))


@query("shot_scan", "SELECT l_partkey % 7 AS player_id, count(*) AS shots, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS made, round(avg(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END), 6) AS distance FROM lineitem WHERE l_partkey % 7 IN (1, 2, 5) AND l_linenumber >= 2 GROUP BY 1")
def shot_scan(spark, sf):
    """Shots of listed players, from files of which some have no distance; the list is a filter of the scan."""
    line, path = read(spark, sf, "lineitem"), archive.scratch(spark, "shots")
    rows = line.select((F.col("l_partkey") % 7).alias("player_id"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("shot_made"), F.col("l_quantity").cast("double").alias("shot_distance"), F.col("l_linestatus").alias("action_type"), F.lit("Mid").alias("shot_zone_basic"), F.col("l_linenumber").cast("int").alias("_season"), (F.col("l_suppkey") % 2).alias("_far"))
    rows.filter("_far = 0").drop("_far").write.parquet(f"{path}/part=0")
    rows.filter("_far = 1").drop("_far", "shot_distance").write.parquet(f"{path}/part=1")
    found = events.scan_events(spark, path, SHOTS + ", _season int", first=2, keys=[1, 2, 5])
    return _rounded(found.groupBy("player_id").agg(F.count("*").alias("shots"), F.sum("shot_made").alias("made"), F.avg("shot_distance").alias("distance")), ["player_id", "shots"], 6)


@query("live_over_history", """WITH h AS (SELECT o_custkey AS player_id, year(o_orderdate) AS season, sum(CAST(o_totalprice AS DOUBLE)) AS points, count(*) AS games FROM orders GROUP BY 1, 2), l AS (SELECT c_custkey AS player_id, 1998 AS season, CAST(c_acctbal AS DOUBLE) AS points FROM customer WHERE c_custkey % 4 = 0),
i AS (SELECT o_custkey AS player_id, year(o_orderdate) AS season, arg_max(o_orderkey % 100, o_orderkey) AS dpm FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), u AS (SELECT h.* FROM h LEFT JOIN l USING (player_id, season) WHERE l.player_id IS NULL UNION ALL SELECT player_id, season, points, NULL FROM l)
SELECT player_id, CAST(season AS BIGINT) AS season, round(points, 4) AS points, games, dpm FROM u LEFT JOIN i USING (player_id, season)""")
def live_over_history(spark, sf):
    o = read(spark, sf, "orders").withColumn("season", F.year("o_orderdate").cast("long")).withColumnRenamed("o_custkey", "player_id")
    history = o.groupBy("player_id", "season").agg(F.sum(F.col("o_totalprice").cast("double")).alias("points"), F.count("*").alias("games"))
    live = read(spark, sf, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("player_id"), F.lit(1998).cast("long").alias("season"), F.col("c_acctbal").cast("double").alias("points"), F.lit("x").alias("extra"))
    impact = o.filter("o_orderstatus = 'F'").select("player_id", "season", (F.col("o_orderkey") % 100).alias("dpm"), F.col("o_orderkey").alias("updated"))
    return _rounded(events.player_seasons(history, live, impact), ["player_id", "season"], 4)


_TEAM_GAMES = """WITH g AS (SELECT CASE o_custkey % 3 WHEN 0 THEN '2021-22' WHEN 1 THEN '2013-14' ELSE '2019-20' END AS season, CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'playoffs' ELSE 'regular' END AS t, CASE WHEN o_custkey % 2 = 0 THEN 20000000 ELSE 40000000 END + o_orderkey % 300 AS game_id, o_custkey % 30 AS team_id, o_orderdate AS d, o_orderkey AS k FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY season, game_id, team_id ORDER BY d DESC, k DESC) AS r FROM g WHERE season >= '2014-15' AND (t = 'regular' OR (t = 'unknown' AND game_id < 30000000)))"""


@query("team_games", _TEAM_GAMES + " SELECT season, game_id, team_id, k AS order_key FROM f WHERE r = 1")
def team_games(spark, sf):
    """Stored team games, of which those of unknown type count when their id is that of a regular one."""
    o, path = read(spark, sf, "orders"), archive.scratch(spark, "team-games")
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(
        F.when(who % 3 == 0, "2021-22").when(who % 3 == 1, "2013-14").otherwise("2019-20").alias("season"), F.when(key % 4 == 0, "unknown").when(key % 4 == 1, "playoffs").otherwise("regular").alias("season_type"), (F.when(who % 2 == 0, 20000000).otherwise(40000000) + key % 300).alias("game_id"),
        (who % 30).alias("team_id"), F.col("o_orderdate").alias("game_date"), key.alias("order_key"),
    )
    archive.write_partitions(rows, path)
    return events.load_team_games(spark, path).select("season", "game_id", "team_id", "order_key")


@query("rebuilt_totals", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN '2023-24' ELSE '2022-23' END AS season, o_custkey AS player_id, count(*) AS games, round(CAST(sum(o_orderkey % 4) AS DOUBLE), 6) AS points_total, round(avg(o_orderkey % 4), 6) AS points_per_game, round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 5 END), 6) AS minutes_per_game FROM orders WHERE (o_orderkey % 3 = 1 OR (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_custkey % 4 <> 0)) AND (coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 5 END, 0) > 0 OR o_orderkey % 4 <> 0) GROUP BY 1, 2")
def rebuilt_totals(spark, sf):
    """The archive is written, rebuilt with repaired types, and season totals are made anew from it."""
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(
        F.when(k % 2 == 0, "2023-24").otherwise("2022-23").alias("season"), F.when(k % 3 == 0, "other").when(k % 3 == 1, "regular").otherwise("playoffs").alias("season_type"), F.lit("2023-11-20").alias("game_date"), F.when(F.col("o_custkey") % 4 == 0, "N/A").otherwise("OPP").alias("opponent"),
        F.when(F.col("o_orderstatus") != "P", (k % 5).cast("double")).alias("minutes"), (k % 4).cast("double").alias("points"), k.alias("game_id"), F.col("o_custkey").alias("player_id"),
    )
    first, again = archive.scratch(spark, "games"), archive.scratch(spark, "games-rebuilt")
    archive.write_partitions(rows, first)
    archive.rebuild(spark.read.parquet(first), again, ["points"])
    out = events.rebuild_totals(spark.read.parquet(again), archive.scratch(spark, "season-totals"), ["points"])
    return _rounded(out.select("season", "player_id", "games", "points_total", "points_per_game", "minutes_per_game"), ["season", "player_id", "games"], 6)
