"""Queries over archives: snapshots of a season, team and shot archives, rebuilds, ratings, stints. What is written is read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.operators.joins import require_unique
from tallyforge.plans.base import query, read
from tallyforge.plans.players import LINES, PLACE, WHO, TEAMS, _games, _lines, _people, _rounded
from tallyforge.plans.seasons import _orders
from tallyforge.sources import archive

SEASON = "1998-99"
RAW = {"points": "2 * l_linenumber", "assists": "l_linenumber % 4", "blocks": "CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END", "steals": "CASE WHEN l_quantity < 8 THEN 1 ELSE 0 END", "turnovers": "CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END", "reboundsTotal": "l_linenumber % 3", "fieldGoalsAttempted": "l_linenumber + 1", "fieldGoalsMade": "l_linenumber - l_linenumber % 2",
       "threePointersAttempted": "CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END", "threePointersMade": "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END", "freeThrowsAttempted": "l_linenumber % 3", "freeThrowsMade": "CASE WHEN l_linenumber % 3 = 2 THEN 1 ELSE 0 END"}
RAW_SQL = LINES + """, gb AS (SELECT player_id, season, game_id, strftime(game_date, '%Y-%m-%d') AS day, CASE WHEN game_id % 9 = 0 THEN 'Playoffs' ELSE 'Regular Season' END AS kind, CASE WHEN game_id % 11 <> 0 THEN sum(l_quantity) END AS minutes, """ + ", ".join(f'CAST(sum({x}) AS DOUBLE) AS "{n}"' for n, x in RAW.items()) + " FROM ln GROUP BY player_id, season, game_id, game_date)"


def _raw_games(spark, sf):
    sums = [F.sum(F.expr(x)).cast("double").alias(n) for n, x in RAW.items()]
    rows = _lines(spark, sf).groupBy("player_id", "season", "game_id", "game_date").agg(F.sum("l_quantity").alias("m"), *sums)
    return rows.select(
        F.col("player_id").alias("personId"), F.col("game_id").alias("gameId"), F.concat(F.date_format("game_date", "yyyy-MM-dd"), F.lit(" 19:00:00")).alias("gameDate"), F.when(F.col("game_id") % 9 == 0, "Playoffs").otherwise("Regular Season").alias("gameType"),
        F.when(F.col("game_id") % 11 != 0, F.col("m")).alias("numMinutes"), F.lit(" Pat ").alias("firstName"), F.col("player_id").cast("string").alias("lastName"), (F.col("game_id") % 30).alias("playerteamId"), *RAW,
    )


@query("season_snapshot", RAW_SQL + WHO + f""", k AS (SELECT * FROM gb WHERE kind = 'Regular Season' AND day >= '1998-09-01' AND day < '1999-07-01' AND coalesce(minutes, 0) > 0), e AS (SELECT * FROM k WHERE player_id IN (SELECT player_id FROM k GROUP BY 1 HAVING count(DISTINCT game_id) >= 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY day DESC, game_id DESC) AS nth FROM e)
SELECT r.player_id, count(*) AS games_played, round(avg(minutes), 9) AS minutes_per_game, round(avg(points), 9) AS points_per_game, round(sum("fieldGoalsMade") / nullif(sum("fieldGoalsAttempted"), 0), 9) AS field_goal_percentage, round(sum("threePointersMade") / nullif(sum("threePointersAttempted"), 0), 9) AS three_point_percentage,
  'Pat ' || r.player_id AS player_name, max(game_id % 30) FILTER (nth = 1) AS team_id, any_value({PLACE}) AS position, count(*) FILTER (nth <= 2) AS recent_games, CAST(sum(points) FILTER (nth <= 2) AS BIGINT) AS recent_points, max(lpad(CAST(game_id AS VARCHAR), 10, '0')) FILTER (nth = 1) AS last_game FROM r JOIN bio USING (player_id) GROUP BY r.player_id""")
def season_snapshot(spark, sf):
    people = _people(spark, sf).withColumnRenamed("player_id", "personId")
    games = archive.season_games(_raw_games(spark, sf), SEASON)
    players, seasons, shown = archive.season_snapshot(games, people, SEASON, least_games=2, recent=2)
    recent = shown.groupBy("player_id").agg(F.count("*").alias("recent_games"), F.sum("points").alias("recent_points"), F.max_by("game_id", F.struct("game_date", "game_id")).alias("last_game"))
    out = seasons.join(players, "player_id").join(recent, "player_id")
    return _rounded(out.select("player_id", "games_played", "minutes_per_game", "points_per_game", "field_goal_percentage", "three_point_percentage", "player_name", "team_id", "position", "recent_games", "recent_points", "last_game"), ["player_id"])


@query("team_archive", f"""{LINES}, t AS (SELECT season, CASE game_id % 5 WHEN 0 THEN 'Playoffs' WHEN 1 THEN 'In Season Tournament' WHEN 2 THEN 'unknown' WHEN 3 THEN 'Exhibition' ELSE 'Regular Season' END AS k, game_id, player_id FROM ln WHERE player_id % 50 <> 0 GROUP BY ALL)
SELECT season, CASE k WHEN 'Playoffs' THEN 'playoffs' WHEN 'unknown' THEN 'unknown' WHEN 'Exhibition' THEN 'other' ELSE 'regular' END AS season_type, count(*) AS team_rows, count(DISTINCT 'City ' || player_id % 9) AS teams FROM t GROUP BY 1, 2""")
def team_archive(spark, sf):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("Playoffs", "In Season Tournament", "unknown", "Exhibition", "Regular Season")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    raw = _orders(spark, sf).join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(
        F.col("o_orderkey").alias("gameId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("gameDate"), kinds.alias("gameType"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("teamId"), F.lit(" City").alias("teamCity"), (F.col("o_custkey") % 9).cast("string").alias("teamName"),
    )
    path = archive.scratch(spark, "team-archive")
    counts = archive.write_partitions(archive.normalise_team_games(raw), path).withColumnRenamed("count", "team_rows")
    teams = spark.read.parquet(path).groupBy("season", "season_type").agg(F.countDistinct("team").alias("teams"))
    return counts.join(teams, ["season", "season_type"]).select("season", "season_type", "team_rows", "teams")


@query("players_archive", "SELECT c_custkey % 500 AS player_id, min(c_name) AS name FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1")
def players_archive(spark, sf):
    ident = F.when(F.col("c_custkey") % 7 == 0, "none").otherwise((F.col("c_custkey") % 500).cast("string"))
    raw = read(spark, sf, "customer").select(ident.alias("personId"), F.col("c_name").alias("name"), "c_acctbal")
    out = archive.build_players(raw, archive.scratch(spark, "players"))
    require_unique(out, ["player_id"])
    return out.select("player_id", "name")


SHOT_RAW = {"PLAYER_ID": "player_id", "SHOT_MADE_FLAG": "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END", "SHOT_DISTANCE": "l_quantity - 1", "ACTION_TYPE": "CASE l_linenumber % 4 WHEN 0 THEN 'Step Back Jump shot' WHEN 1 THEN 'Driving Layup Shot' WHEN 2 THEN 'Slam Dunk Shot' ELSE 'Jump Shot' END", "SHOT_ZONE_BASIC": "CASE l_returnflag WHEN 'R' THEN 'In The Paint (Non-RA)' WHEN 'N' THEN 'Mid-Range' ELSE 'Above the Break 3' END",
            "_season": "year(l_shipdate)", "_season_type": "CASE l_linenumber WHEN 7 THEN 'po' WHEN 6 THEN 'pre' ELSE 'rg' END"}


@query("shot_archive", LINES + """, s AS (SELECT player_id, printf('%04d-%02d', year(l_shipdate), (year(l_shipdate) + 1) % 100) AS season, l_linenumber AS ln, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0 END AS made, CASE WHEN l_quantity <= 5 THEN 'rim' WHEN l_returnflag = 'R' THEN 'paint' WHEN l_returnflag = 'N' THEN 'midrange' ELSE 'three_point' END AS zone, CASE l_linenumber % 4 WHEN 0 THEN 'step_back' WHEN 1 THEN 'layup' WHEN 2 THEN 'dunk' ELSE 'other' END AS act, l_quantity - 1 AS far FROM ln),
g AS (SELECT * FROM s WHERE ln < 6), m AS (SELECT season, avg(made) AS m FROM g GROUP BY 1), c AS (SELECT season, zone, act, (sum(made) + 25 * any_value(m)) / (count(*) + 25) AS e FROM g JOIN m USING (season) GROUP BY 1, 2, 3), n AS (SELECT season, count(*) AS season_shots FROM s GROUP BY 1)
SELECT player_id, season, count(*) AS shot_attempts, round(avg(CASE WHEN zone = 'rim' THEN 1.0 ELSE 0 END), 9) AS rim_frequency, round(avg(CASE WHEN act = 'dunk' THEN 1.0 ELSE 0 END), 9) AS dunk_frequency, round(avg(far), 9) AS average_shot_distance, round(least(1, greatest(0, 1 - avg(e))), 9) AS shot_difficulty_index, round(avg(made) - avg(e), 9) AS shot_making_above_expected, any_value(season_shots) AS season_shots
FROM g JOIN c USING (season, zone, act) JOIN n USING (season) GROUP BY 1, 2""")
def shot_archive(spark, sf):
    raw = _lines(spark, sf).select(*[F.expr(x).alias(n) for n, x in SHOT_RAW.items()])
    profiles, counts = archive.build_shots(raw, archive.scratch(spark, "shot-profiles"))
    totals = counts.groupBy("season").agg(F.sum("shot_event_rows").alias("season_shots"))
    out = profiles.join(totals, "season")
    return _rounded(out.select("player_id", "season", "shot_attempts", "rim_frequency", "dunk_frequency", "average_shot_distance", "shot_difficulty_index", "shot_making_above_expected", "season_shots"), ["player_id", "season"])


@query("archive_rebuild", """WITH g AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '2023-24' ELSE '2022-23' END AS season, CASE o_orderkey % 3 WHEN 0 THEN 'other' WHEN 1 THEN 'regular' ELSE 'playoffs' END AS t, make_date(2023, 11, CAST(1 + o_custkey % 30 AS INTEGER)) AS d, CASE WHEN o_custkey % 4 = 0 THEN 'N/A' ELSE 'OPP' END AS opp, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 5 END AS minutes, o_orderkey % 4 AS points FROM orders)
SELECT season, CASE WHEN season = '2023-24' AND t = 'other' AND d BETWEEN '2023-11-03' AND '2023-12-08' AND opp <> 'N/A' THEN 'regular' ELSE t END AS season_type, count(*) AS box_score_rows FROM g WHERE coalesce(minutes, 0) > 0 OR points <> 0 GROUP BY 1, 2""")
def archive_rebuild(spark, sf):
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(
        F.when(k % 2 == 0, "2023-24").otherwise("2022-23").alias("season"), F.when(k % 3 == 0, "other").when(k % 3 == 1, "regular").otherwise("playoffs").alias("season_type"), F.make_date(F.lit(2023), F.lit(11), (1 + F.col("o_custkey") % 30).cast("int")).cast("string").alias("game_date"),
        F.when(F.col("o_custkey") % 4 == 0, "N/A").otherwise("OPP").alias("opponent"), F.when(F.col("o_orderstatus") != "P", (k % 5).cast("double")).alias("minutes"), (k % 4).cast("double").alias("points"), k.alias("game_id"),
    )
    first, again = archive.scratch(spark, "games"), archive.scratch(spark, "games-rebuilt")
    archive.write_partitions(rows, first)
    return archive.rebuild(spark.read.parquet(first), again, ["points"]).withColumnRenamed("count", "box_score_rows")


@query("impact_history", """WITH r AS (SELECT o_custkey % 900 AS player_id, year(o_orderdate) + 1 AS y, o_orderkey, o_totalprice / 1e5 AS dpm, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 7 END AS a, o_orderkey % 5 AS b FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY player_id, y ORDER BY o_orderkey DESC) AS n FROM r)
SELECT printf('%04d-%02d', y - 1, y % 100) AS season, player_id, round(dpm, 9) AS dpm, CAST(a + b AS DOUBLE) AS box_dpm FROM k WHERE n = 1""")
def impact_history(spark, sf):
    k = F.col("o_orderkey")
    records = read(spark, sf, "orders").select(
        (F.col("o_custkey") % 900).cast("string").alias("nba_id"), F.lit("x").alias("player_name"), (F.year("o_orderdate") + 1).cast("string").alias("season"), (F.col("o_totalprice") / 1e5).alias("dpm"), F.lit(0.0).alias("o_dpm"), F.lit(0.0).alias("d_dpm"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((k % 7).cast("string")).alias("box_odpm"), (k % 5).cast("string").alias("box_ddpm"), k.alias("order"),
    )
    return _rounded(archive.normalise_impact(records).select("season", "player_id", "dpm", "box_dpm"), ["season", "player_id"])


@query("player_profile", RAW_SQL + """, st AS (SELECT player_id, season, count(*) AS games_played FROM gb GROUP BY 1, 2), sp AS (SELECT player_id, season, count(*) AS sa, count(*) FILTER (l_returnflag = 'A') AS sm, count(*) FILTER (l_quantity > 23) AS ta, count(*) FILTER (l_quantity > 23 AND l_returnflag = 'A') AS tm FROM ln WHERE player_id % 6 <> 0 GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS r FROM st)
SELECT c_custkey AS player_id, season, games_played, round(sm * 1.0 / games_played, 9) AS field_goals_made_per_game, round(ta * 1.0 / games_played, 9) AS three_point_attempts_per_game, round((sm - tm) * 1.0 / nullif(sa - ta, 0), 9) AS two_point_percentage, round((sm + 0.5 * tm) / nullif(sa, 0), 9) AS effective_field_goal_percentage, CASE WHEN coalesce(ta, 0) <> 0 THEN CAST(0.35 AS DOUBLE) END AS three_point_percentage
FROM customer JOIN x ON x.player_id = c_custkey AND r = 1 LEFT JOIN sp USING (player_id, season)""")
def player_profile(spark, sf):
    seasons = _raw_games(spark, sf).withColumn("season", labels.season_of(F.to_date(F.col("gameDate").substr(1, 10)))).groupBy(F.col("personId").alias("player_id"), "season").agg(F.count("*").alias("games_played")).withColumn("three_point_percentage", F.lit(0.35))
    long, made = F.col("l_quantity") > 23, F.col("l_returnflag") == "A"
    shots = _lines(spark, sf).filter("player_id % 6 <> 0").groupBy("player_id", "season").agg(F.count("*").alias("shot_attempts"), F.count_if(made).alias("shot_makes"), F.count_if(long).alias("three_point_attempts"), F.count_if(long & made).alias("three_point_makes"))
    players = read(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), "c_name")
    out = archive.player_profiles(players, seasons, shots)
    return _rounded(out.select("player_id", "season", "games_played", "field_goals_made_per_game", "three_point_attempts_per_game", "two_point_percentage", "effective_field_goal_percentage", "three_point_percentage"), ["player_id"])


STINTS = RAW_SQL + ", sn AS (SELECT season, 'T' || game_id % 4 AS team, player_id, sum(minutes) AS team_minutes, count(DISTINCT game_id) AS games_with_team, max(day) AS last_game_date FROM gb WHERE minutes > 0 AND game_id % 4 <> 3 GROUP BY 1, 2, 3), sr AS (SELECT *, row_number() OVER (PARTITION BY season, player_id ORDER BY last_game_date DESC, team_minutes DESC, team DESC) AS r FROM sn)"


def _stint_games(spark, sf):
    day = F.col("gameDate").substr(1, 10)
    return _raw_games(spark, sf).select(labels.season_of(F.to_date(day)).alias("season"), F.concat(F.lit("T"), (F.col("gameId") % 4).cast("string")).alias("team"), F.col("personId").alias("player_id"), F.col("gameId").alias("game_id"), day.alias("game_date"), F.col("numMinutes").alias("minutes"))


@query("team_stints", STINTS + " SELECT season, team, player_id, team_minutes, games_with_team, last_game_date, r = 1 AS is_primary FROM sr")
def team_stints(spark, sf):
    stints = archive.team_stints(_stint_games(spark, sf), ["T0", "T1", "T2"])
    first = archive.primary_stints(stints).select("season", "player_id", "team", F.lit(True).alias("_p"))
    return stints.join(first, ["season", "player_id", "team"], "left").withColumn("is_primary", F.coalesce("_p", F.lit(False))).select("season", "team", "player_id", "team_minutes", "games_with_team", "last_game_date", "is_primary")


@query("season_teams", RAW_SQL + ", nm AS (SELECT *, CASE WHEN game_id % 4 = 3 THEN ' ' ELSE 'T' || game_id % 4 END AS team FROM gb) SELECT season, player_id, arg_max(team, (day, game_id)) AS team FROM nm WHERE trim(team) <> '' GROUP BY 1, 2")
def season_teams(spark, sf):
    games = _stint_games(spark, sf)
    return archive.season_team(games.withColumn("team", F.when(F.col("team") == "T3", " ").otherwise(F.col("team"))))


@query("last_seasons", RAW_SQL + ", s AS (SELECT DISTINCT player_id, season FROM gb), r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS r FROM s), k AS (SELECT *, count(*) OVER (PARTITION BY player_id) AS n FROM r WHERE r <= 3) SELECT player_id, season FROM k WHERE n >= 2")
def last_seasons(spark, sf):
    return archive.last_seasons(_lines(spark, sf).select("player_id", "season").distinct())


@query("competition_rank", TEAMS + " SELECT season, team_id, rank() OVER (PARTITION BY season ORDER BY round(defensive_rating)) AS defensive_rank FROM tf")
def competition_rank(spark, sf):
    from tallyforge.operators.features import team_seasons

    rows = team_seasons(_games(spark, sf)).select("season", "team_id", F.round("defensive_rating").alias("d"))
    return rows.select("season", "team_id", F.rank().over(Window.partitionBy("season").orderBy(F.col("d").asc_nulls_last())).cast("long").alias("defensive_rank"))  # teams of a season


@query("archive_coverage", "SELECT year(o_orderdate) AS season, count(*) AS rows FROM orders GROUP BY 1")
def archive_coverage(spark, sf):
    """Coverage as it is written, and read back; a folder that isn't there has an empty one."""
    path = archive.scratch(spark, "archive")
    rows = read(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("season")).agg(F.count("*").alias("rows"))
    archive.write_metadata(rows, path)
    none = archive.read_coverage(spark, f"{path}/absent", "season long, rows long")
    told = archive.read_metadata(spark, f"{path}/metadata").select("season")
    return archive.read_coverage(spark, f"{path}/coverage").unionByName(none).join(told, "season", "left_semi")


