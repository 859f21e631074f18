"""Queries over a team's needs: gaps, recommended candidates, consensus, the candidate pool, the elite model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.ratios import ratio
from tallyforge.operators import features, team
from tallyforge.plans.base import query
from tallyforge.plans.players import LINES, PLACE, POOL_SEASON, PROFILE, STATS, TEAMS, TRAITS_SQL, WHO, _candidates, _games, _lines, _people, _rounded, _shot_profiles, _stats
from tallyforge.sources.scratch import kept

TEAM_ID, TEAM_NAME = 4, "T3"
COEFFICIENTS = {f: round(0.9 - 0.13 * i, 2) for i, f in enumerate(features.TEAM_FEATURES)}
LEAST = {"least_games": 2, "least_minutes": 20}


def _teams(spark, sf):
    return kept(features.team_seasons(_games(spark, sf)), "team-seasons")


def _needs_sql(grid):
    names = ", ".join(features.TEAM_FEATURES)
    return (
        ", sc AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in grid) + ") AS t(top_n, lookback)), "
        f"ss AS (SELECT season, row_number() OVER (ORDER BY season DESC) AS k FROM (SELECT DISTINCT season FROM tf WHERE season <= '{POOL_SEASON}')), "
        f"w AS (SELECT top_n, lookback, season, team_id, league_rank <= top_n AS elite, {names} FROM sc JOIN ss ON k <= lookback JOIN tf USING (season)), "
        f"lg AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR feature IN ({names}))), lz AS (SELECT *, (value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0) AS z FROM lg WINDOW p AS (PARTITION BY top_n, lookback, season, feature)), "
        "co AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', CAST({v} AS DOUBLE))" for f, v in COEFFICIENTS.items()) + ") AS t(feature, coefficient)), "
        "tr AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{t}')" for f, t in team.TRAIT_OF.items()) + ") AS t(feature, trait)), "
        f"own AS (SELECT top_n, lookback, feature, value AS team_value, z AS team_z FROM lz WHERE season = '{POOL_SEASON}' AND team_id = {TEAM_ID}), "
        f"ag AS (SELECT lz.top_n, lz.lookback, feature, coefficient, team_value, team_z, median(z) FILTER (elite) AS target_z, median(value) FILTER (elite AND season = '{POOL_SEASON}') AS elite_median, coalesce(avg(CASE WHEN sign(coefficient) * z > 0 THEN 1.0 ELSE 0 END) FILTER (elite AND z IS NOT NULL), 0) AS elite_stability, "
        f"(count(*) FILTER (season = '{POOL_SEASON}' AND sign(coefficient) * value < sign(coefficient) * team_value) + (count(*) FILTER (season = '{POOL_SEASON}' AND value = team_value) + 1) / 2) / nullif(count(value) FILTER (season = '{POOL_SEASON}'), 0) AS team_percentile "
        "FROM lz JOIN own USING (top_n, lookback, feature) JOIN co USING (feature) GROUP BY ALL), "
        f"gp AS (SELECT *, abs(coefficient) / {sum(map(abs, COEFFICIENTS.values()))} AS importance, greatest(0, sign(coefficient) * (target_z - team_z)) AS gap_z FROM ag), "
        "gq AS (SELECT *, gap_z * importance * elite_stability AS priority FROM gp JOIN tr USING (feature)), "
        "gt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY top_n, lookback ORDER BY priority DESC, feature) AS nr FROM gq WHERE priority > 0) WHERE nr <= 6), "
        "wt AS (SELECT top_n, lookback, trait, sum(priority) / sum(sum(priority)) OVER (PARTITION BY top_n, lookback) AS weight FROM gt GROUP BY 1, 2, 3)"
    )


@query("team_gaps", TEAMS + _needs_sql([(8, 5)]) + " SELECT feature, round(team_value, 9) AS team_value, round(elite_median, 9) AS elite_median, round(team_percentile, 9) AS team_percentile, round(importance, 9) AS importance, round(elite_stability, 9) AS elite_stability, round(gap_z, 9) AS gap_z, round(priority, 9) AS priority, CASE WHEN coefficient >= 0 THEN 'higher' ELSE 'lower' END AS desired, trait FROM gq")
def team_gaps(spark, sf):
    out = team.needs(_teams(spark, sf), POOL_SEASON, TEAM_ID, COEFFICIENTS)
    return _rounded(out.select("feature", "team_value", "elite_median", "team_percentile", "importance", "elite_stability", "gap_z", "priority", "desired", "trait"), ["feature"])


def _joined(traits: str) -> str:
    """Both chains in one statement: the second one's shared tables are those of the first."""
    return TEAMS + traits[len(LINES):]


_FIT = "sum(weight * CASE trait " + " ".join(f"WHEN '{t}' THEN trait_{t}" for t in features.CANDIDATE_TRAITS) + " END) * (0.75 + 0.25 * least(1, games_played / 50.0))"
_ROWS = f", rc AS (SELECT top_n, lookback, player_id, any_value(position) AS position, games_played, {_FIT} AS fit_score FROM ct CROSS JOIN wt WHERE games_played >= 2 AND minutes_per_game >= 20 AND team <> '{TEAM_NAME}' GROUP BY top_n, lookback, player_id, games_played), rb AS (SELECT *, CASE WHEN contains(position, 'C') THEN 'C' WHEN contains(position, 'G') THEN 'G' ELSE 'F' END AS position_bucket FROM rc)"
_CAP = ", rk AS (SELECT *, row_number() OVER (PARTITION BY top_n, lookback, position_bucket ORDER BY fit_score DESC, games_played DESC, player_id) AS place FROM rb), rn AS (SELECT *, row_number() OVER (PARTITION BY top_n, lookback ORDER BY fit_score DESC, games_played DESC, player_id) AS nr FROM rk WHERE place <= {most})"
_NAMES = " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in team.TRAIT_NAMES.items())
_VALUE = " ".join(f"WHEN '{t}' THEN trait_{t}" for t in features.CANDIDATE_TRAITS)


@query("recommend_players", _joined(TRAITS_SQL) + _needs_sql([(8, 5)]) + _ROWS + _CAP.format(most=3) + f""", t3 AS (SELECT trait, row_number() OVER (ORDER BY weight DESC, trait) AS k FROM wt), re AS (SELECT player_id, string_agg(CASE trait {_NAMES} END || ' ' || CAST(round(100 * CASE trait {_VALUE} END) AS INTEGER) || '%ile', ', ' ORDER BY k) AS fit_reasons FROM ct CROSS JOIN t3 WHERE k <= 3 GROUP BY player_id)
SELECT rn.player_id, position, games_played, round(least(1, games_played / 50.0), 9) AS data_reliability, round(fit_score, 9) AS fit_score, fit_reasons FROM rn JOIN re USING (player_id) WHERE nr <= 8""")
def recommend_players(spark, sf):
    gaps = team.needs(_teams(spark, sf), POOL_SEASON, TEAM_ID, COEFFICIENTS)
    out = team.recommend(features.candidate_traits(_candidates(spark, sf)), team.trait_weights(gaps), TEAM_NAME, **LEAST)
    return _rounded(out.select("player_id", "position", "games_played", "data_reliability", "fit_score", "fit_reasons"), ["player_id"])


@query("consensus", _joined(TRAITS_SQL) + _needs_sql(team.GRID) + _ROWS + _CAP.format(most=4) + """, cs AS (SELECT player_id, position_bucket, count(DISTINCT top_n * 100 + lookback) / 9.0 AS selection_rate, avg(fit_score) AS fit_score FROM rn WHERE nr <= 12 GROUP BY 1, 2), cr AS (SELECT *, fit_score * (0.5 + 0.5 * selection_rate) AS robust_fit_score FROM cs),
cq AS (SELECT *, row_number() OVER (PARTITION BY position_bucket ORDER BY robust_fit_score DESC, selection_rate DESC, player_id) AS place FROM cr)
SELECT player_id, position_bucket, round(selection_rate, 9) AS selection_rate, round(fit_score, 9) AS fit_score, round(robust_fit_score, 9) AS robust_fit_score FROM cq WHERE place <= 3 ORDER BY cq.robust_fit_score DESC, cq.selection_rate DESC, player_id LIMIT 8""")
def consensus(spark, sf):
    out = team.consensus(features.candidate_traits(_candidates(spark, sf)), _teams(spark, sf), POOL_SEASON, TEAM_ID, TEAM_NAME, COEFFICIENTS, **LEAST)
    return _rounded(out.select("player_id", "position_bucket", "selection_rate", "fit_score", "robust_fit_score"), ["player_id"])


@query("elite_model")
def elite_model(spark, sf):
    """The fitted coefficient of each feature, by cohort of eight."""
    rows = _teams(spark, sf)
    _, _, found = team.elite_model(rows, least_games=0)
    return spark.createDataFrame([(k, v) for k, v in found.items()], "feature string, coefficient double")  # fifteen


@query("candidate_pool", STATS + PROFILE + WHO + f""", lt AS (SELECT player_id, arg_max('S' || game_id % 7, (game_date, game_id)) AS team FROM ln WHERE season = '{POOL_SEASON}' GROUP BY 1)
SELECT st.player_id, games_played, CASE WHEN three_point_attempts_total <> 0 THEN round(three_points_made_total / three_point_attempts_total, 9) END AS three_point_percentage, shot_attempts, round(rim_frequency, 9) AS rim_frequency, team, {PLACE} AS position
FROM st LEFT JOIN sp USING (player_id, season) LEFT JOIN lt ON lt.player_id = st.player_id LEFT JOIN bio ON bio.player_id = st.player_id WHERE season = '{POOL_SEASON}'""")
def candidate_pool(spark, sf):
    seasons = _stats(spark, sf).withColumn("three_point_percentage", F.coalesce(ratio(F.col("three_points_made_total"), F.col("three_point_attempts_total")), F.lit(0.0)))
    games = _lines(spark, sf).select("player_id", "season", "game_date", "game_id", F.concat(F.lit("S"), (F.col("game_id") % 7).cast("string")).alias("team"))
    out = team.pool(seasons, _shot_profiles(spark, sf), games, _people(spark, sf), POOL_SEASON)
    return _rounded(out.select("player_id", "games_played", "three_point_percentage", "shot_attempts", "rim_frequency", "team", "position"), ["player_id"])



