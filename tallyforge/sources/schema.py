"""Schemas of the inputs, and the checks that stop a job early."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

#: Names and types of the columns of the input files.
PLAYER_GAMES = """firstName string, lastName string, personId long, gameId long, gameDate string, gameType string, numMinutes double,
points double, assists double, blocks double, steals double, turnovers double, reboundsTotal double, reboundsOffensive double, reboundsDefensive double,
foulsPersonal double, plusMinusPoints double, fieldGoalsAttempted double, fieldGoalsMade double, threePointersAttempted double, threePointersMade double,
freeThrowsAttempted double, freeThrowsMade double, playerteamId long, opponentteamId long"""
SHOTS = "player_id long, shot_made int, shot_distance double, action_type string, shot_zone_basic string"
ACTIONS = """actionType string, subType string, qualifiers string, personId long, assistPersonId double, possession long, orderNumber long,
clock string, period int, gameId long, shotResult string, _season int, _season_type string"""
MATCHUPS = """matchups_person_id long, person_id long, position string, game_id long, partial_possessions double, matchup_field_goals_attempted long,
matchup_three_pointers_attempted long, matchup_turnovers long, matchup_blocks long, shooting_fouls long, _season int, _season_type string"""
OPTIONAL_GAME_COLUMNS = {"reboundsOffensive", "reboundsDefensive", "foulsPersonal", "plusMinusPoints"}


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "input") -> DataFrame:
    lacking = sorted(set(needed) - set(df.columns))
    if lacking:
        raise ValueError(f"{what} lacks the columns {', '.join(lacking)}")
    return df


def snake_case(name: str) -> str:
    """camelCase to snake_case: a capital after a small letter or a digit begins a word; gameDateTimeEst is game_datetime_est."""
    out = ""
    for before, c in zip(" " + name, name, strict=False):
        out += ("_" if c.isascii() and c.isupper() and before.isascii() and (before.islower() or before.isdigit()) else "") + c.lower()
    return out.replace("date_time_est", "datetime_est")
