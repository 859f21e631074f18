"""A season-partitioned Parquet archive: reading raw files, writing partitions, coverage, point lookups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.functions.ratios import finite
from tallyforge.operators.joins import require_subset, require_unique
from tallyforge.sources.scratch import scratch  # noqa: F401
from tallyforge.sources.schema import OPTIONAL_GAME_COLUMNS, require_columns, snake_case


def read_csv(spark: SparkSession, path: str, schema: str, optional: Iterable[str] = ()) -> DataFrame:
    """A CSV with a header, by column name: the schema's columns must be there, optional ones may be; values that
    don't parse are null. Splits of the file are read in parallel."""
    wanted = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, set(wanted) - set(optional), path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).try_cast(t).alias(c) for c, t in wanted.items() if c in raw.columns])


def normalise_games(raw: DataFrame) -> DataFrame:
    """Player-game rows: names, season and type derived, keys required, rows without any activity dropped.

    Early games have no minutes; such a row stays if any count is not 0.
    """
    require_columns(raw, {"personId", "gameId", "gameDate", "gameType", "numMinutes", "points"}, "player games")
    stats = [f.name for f in raw.schema.fields if f.dataType.simpleString() == "double" and f.name != "numMinutes"]
    date = F.to_date(F.col("gameDate").substr(1, 10).try_cast("date"))
    out = raw.select(
        F.col("personId").cast("long").alias("player_id"),
        F.trim(F.concat_ws(" ", "firstName", "lastName")).alias("player_name"),
        F.col("gameId").cast("long").alias("game_id"),
        date.alias("game_date"),
        labels.season_of(date).alias("season"),
        labels.season_type(F.col("gameType")).alias("season_type"),
        F.col("playerteamId").alias("team_id"),
        F.col("opponentteamId").alias("opponent_id"),
        finite(F.col("numMinutes")).alias("minutes"),
        *[finite(F.col(c)).alias(snake_case(c)) for c in stats],
    )
    active = F.greatest(F.lit(0.0), *[F.abs(F.coalesce(F.col(snake_case(c)), F.lit(0.0))) for c in stats]) > 0
    return out.filter(F.col("player_id").isNotNull() & F.col("game_id").isNotNull() & F.col("game_date").isNotNull() & ((F.coalesce("minutes", F.lit(0.0)) > 0) | active))


def repair_types(games: DataFrame, first: str, last: str) -> DataFrame:
    """Games of unknown kind between two dates with a known opponent count as regular."""
    inside = F.col("game_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("opponent_id").isNotNull()
    return games.withColumn("season_type", F.when((F.col("season_type") == "other") & inside, "regular").otherwise(F.col("season_type")))


def write_partitions(df: DataFrame, path: str, keys: Sequence[str] = ("season", "season_type")) -> DataFrame:
    """Overwrite the partitions that df has (and no others), rows of a partition together; returns their counts.

    The rebalancing shuffle splits large partitions and joins small ones, so a season is neither one huge file nor many small ones.
    Only the partitions that were written are counted.
    """
    df.hint("rebalance", *keys).write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    written = df.select(*keys).distinct()
    return df.sparkSession.read.parquet(path).join(F.broadcast(written), list(keys), "left_semi").groupBy(*keys).count()


def build_games(spark: SparkSession, csv: str, path: str, schema: str) -> DataFrame:
    return write_partitions(normalise_games(read_csv(spark, csv, schema, OPTIONAL_GAME_COLUMNS)), path)


def read_seasons(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, types: Sequence[str] = ("regular", "unknown")) -> DataFrame:
    """Partitions of a season range; labels compare as texts."""
    df = spark.read.parquet(path).filter(F.col("season_type").isin(*types))
    df = df.filter(F.col("season") >= first) if first else df
    return df.filter(F.col("season") <= last) if last else df


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def latest_teams(games: DataFrame) -> DataFrame:
    """The last named team of each player."""
    named = games.filter(F.trim(F.coalesce("team", F.lit(""))) != "")
    return named.groupBy("player_id").agg(F.max_by("team", F.struct("game_date", "game_id")).alias("team"))


def history(spark: SparkSession, path: str, player_id: int) -> DataFrame:
    """Seasons of one player; the filter reaches the files."""
    return spark.read.parquet(path).filter(F.col("player_id") == player_id).orderBy("season")


def validate(players: DataFrame, seasons: DataFrame, games: DataFrame) -> None:
    for name, df in (("players", players), ("seasons", seasons), ("games", games)):
        if df.isEmpty():
            raise ValueError(f"{name} is empty")
    require_subset(seasons, players, "player_id")
    require_subset(games, players, "player_id")
    require_unique(players, ["player_id"])
    require_unique(seasons, ["player_id", "season"])
    require_unique(games, ["player_id", "game_id"])


def repair_by_lookup(rows: DataFrame, found: DataFrame, keys: Sequence[str], column: str, least: float = 0.95) -> DataFrame:
    """Missing values of a column from another table, if at least that share of the rows finds one."""
    both = rows.join(found.select(*keys, F.col(column).alias("_new")), list(keys), "left")
    share = both.filter(F.col(column).isNull()).agg(F.avg(F.when(F.col("_new").isNotNull(), 1.0).otherwise(0.0))).first()[0]
    if share is not None and share < least:
        raise ValueError(f"only {share:.0%} of the missing values were found")
    return both.withColumn(column, F.coalesce(column, "_new")).drop("_new")


def write_metadata(df: DataFrame, path: str) -> None:
    """Coverage as Parquet and as JSON."""
    df.write.mode("overwrite").parquet(f"{path}/coverage")
    df.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")  # a row a season


def available(spark: SparkSession, *paths: str) -> bool:
    """Whether all of the paths exist, in whatever store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    return all(jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p)) for p in paths)


def read_coverage(spark: SparkSession, path: str, schema: str = "season string, season_type string, rows long") -> DataFrame:
    """The coverage table, or an empty one where none was written."""
    return spark.read.parquet(path) if available(spark, path) else spark.createDataFrame([], schema)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if available(spark, path) else spark.createDataFrame([], "season string")


def season_games(raw: DataFrame, season: str) -> DataFrame:
    """Regular games of a season by the first ten characters of their date (September to June), with minutes played.

    A label without a start year is an error.
    """
    start = season.split("-")[0]
    if not start.isdigit():
        raise ValueError(f"{season!r} is no season")
    day = F.col("gameDate").cast("string").substr(1, 10)
    kept = raw.filter((F.col("gameType") == "Regular Season") & (day >= f"{int(start)}-09-01") & (day < f"{int(start) + 1}-07-01"))
    return kept.withColumn("game_date", day).filter(F.coalesce(finite(F.col("numMinutes")), F.lit(0.0)) > 0)


def season_snapshot(games: DataFrame, people: DataFrame, season: str, *, least_games: int = 10, recent: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Players, season stats and last games of the players with enough games in season_games().

    Of rows that repeat player and game the last by date counts. Means are over games, shooting rates over sums.
    """
    c = F.col
    stats = {"minutes": "numMinutes", "points": "points", "rebounds": "reboundsTotal", "assists": "assists", "steals": "steals", "blocks": "blocks", "turnovers": "turnovers"}
    sums = {"field_goal": ("fieldGoalsMade", "fieldGoalsAttempted"), "three_point": ("threePointersMade", "threePointersAttempted"), "free_throw": ("freeThrowsMade", "freeThrowsAttempted")}
    numbers = [*stats.values(), *[x for pair in sums.values() for x in pair]]
    rows = games.withColumns({x: F.coalesce(finite(c(x)), F.lit(0.0)) for x in numbers})
    rows = keep_last(rows, ["personId", "gameId"], ["game_date", *numbers])
    enough = rows.groupBy("personId").agg(F.countDistinct("gameId").alias("n")).filter(c("n") >= least_games).select("personId")
    rows = rows.join(enough, "personId", "left_semi")
    seasons = rows.groupBy(c("personId").alias("player_id")).agg(
        F.countDistinct("gameId").alias("games_played"), *[F.avg(x).alias(f"{n}_per_game") for n, x in stats.items()],
        *[F.try_divide(F.sum(a), F.nullif(F.sum(b), F.lit(0.0))).alias(f"{n}_percentage") for n, (a, b) in sums.items()],
    ).withColumn("season", F.lit(season))
    name = F.trim(F.concat(F.trim(F.coalesce("firstName", F.lit(""))), F.lit(" "), F.trim(F.coalesce("lastName", F.lit("")))))
    last = rows.groupBy(c("personId").alias("player_id")).agg(F.max_by(F.struct(name.alias("player_name"), c("playerteamId").alias("team_id")), F.struct("game_date", "gameId")).alias("l"))
    place = people.select(c("personId").alias("player_id"), labels.position(c("guard"), c("forward"), c("center")).alias("position")).dropDuplicates(["player_id"])
    players = last.select("player_id", "l.*").join(place, "player_id", "left").fillna("N/A", ["position"])
    w = Window.partitionBy("personId").orderBy(F.desc("game_date"), F.desc("gameId"))
    latest = rows.withColumn("_r", F.row_number().over(w)).filter(c("_r") <= recent)
    shown = latest.select(
        F.lpad(c("gameId").cast("long").cast("string"), 10, "0").alias("game_id"), c("personId").alias("player_id"), "game_date", F.bround("numMinutes", 1).alias("minutes"),
        *[F.bround(x).cast("int").alias(n) for n, x in stats.items() if n != "minutes"], *[F.bround(x).cast("int").alias(f"{n}_{k}") for n, pair in sums.items() for k, x in zip(("made", "tried"), pair, strict=True)],
    )
    return players, seasons, shown


def normalise_team_games(raw: DataFrame) -> DataFrame:
    """Team-game rows under snake_case names with season, type, team and opponent; rows without date or team id are dropped."""
    require_columns(raw, {"gameId", "gameDate", "gameType", "teamId", "teamCity", "teamName"}, "team games")
    df = raw.select(*[F.col(f"`{c}`").alias(snake_case(c)) for c in raw.columns])
    named = lambda a, b: F.trim(F.concat(F.trim(F.coalesce(F.col(a).cast("string"), F.lit(""))), F.lit(" "), F.trim(F.coalesce(F.col(b).cast("string"), F.lit("")))))
    date = F.to_date(F.col("game_date").cast("string").substr(1, 10).try_cast("date"))
    df = df.withColumn("game_date", date).withColumns({"season": labels.season_of(F.col("game_date")), "season_type": labels.season_type(F.col("game_type")), "team": named("team_city", "team_name")}).drop("game_type")
    if {"opponent_team_city", "opponent_team_name"} <= set(df.columns):
        df = df.withColumn("opponent", named("opponent_team_city", "opponent_team_name"))
    return df.filter(F.col("game_date").isNotNull() & F.col("team_id").isNotNull())


def build_players(raw: DataFrame, path: str) -> DataFrame:
    """People by player_id, one row each (the first by all columns), all other columns kept; rows without a numeric id are dropped."""
    require_columns(raw, {"personId"}, "players")
    rows = raw.withColumn("player_id", F.col("personId").cast("string").try_cast("double").cast("long")).drop("personId").filter(F.col("player_id").isNotNull())
    w = Window.partitionBy("player_id").orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in rows.columns if c != "player_id"])
    rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.parquet(path)


#: How raw shot columns are called here, and season types by their short names.
SHOT_NAMES = {"PLAYER_ID": "player_id", "SHOT_MADE_FLAG": "shot_made", "SHOT_DISTANCE": "shot_distance", "ACTION_TYPE": "action_type", "SHOT_ZONE_BASIC": "shot_zone_basic"}
SHOT_TYPES = {"rg": "regular", "po": "playoffs"}


def normalise_shots(raw: DataFrame, season: int | None = None, kind: str | None = None) -> DataFrame:
    """Shots under their names here, made within 0 and 1, zone and action; filters on season and type reach the files."""
    require_columns(raw, {*SHOT_NAMES, "_season", "_season_type"}, "shots")
    raw = raw.filter(F.col("_season") == season) if season is not None else raw
    raw = raw.filter(F.col("_season_type") == kind) if kind is not None else raw
    c = F.col
    df = raw.select(*[c(f"`{a}`").alias(b) for a, b in SHOT_NAMES.items()], labels.season_label(c("_season")).alias("season"), F.coalesce(*[F.when(c("_season_type") == k, v) for k, v in SHOT_TYPES.items()], c("_season_type")).alias("season_type"))
    made = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(finite(c("shot_made")), F.lit(0.0))))
    df = df.withColumns({"player_id": c("player_id").cast("string").try_cast("double").cast("long"), "shot_made": made, "zone": labels.zone(c("shot_zone_basic"), finite(c("shot_distance"))), "action": labels.action(c("action_type"))})
    return df.filter(c("player_id").isNotNull())


def build_shots(raw: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes a profile of each player's regular season; returns them and the number of shots by season and type.

    Expected rates are of each season: one job for all seasons.
    """
    shots = normalise_shots(raw)
    counts = shots.groupBy("season", "season_type").agg(F.count("*").alias("shot_event_rows"))
    regular = shots.filter(F.col("season_type") == "regular")
    cells = regular.groupBy("season", "zone", "action").agg(F.sum("shot_made").alias("h"), F.count("*").alias("n"))
    means = cells.groupBy("season").agg((F.sum("h") / F.sum("n")).alias("m"))
    cells = cells.join(means, "season").select("season", "zone", "action", ((F.col("h") + 25 * F.col("m")) / (F.col("n") + 25)).alias("e"))
    own = regular.groupBy("season", "player_id", "zone", "action").agg(F.sum("shot_made").alias("h"), F.count("*").alias("n"), F.sum(F.greatest(F.coalesce(finite(F.col("shot_distance")), F.lit(0.0)), F.lit(0.0))).alias("d"))
    share = lambda column, k: F.sum(F.when(F.col(column) == k, F.col("n")).otherwise(0)) / F.sum("n")
    expected = F.sum(F.col("n") * F.col("e")) / F.sum("n")
    profile = own.join(cells, ["season", "zone", "action"]).groupBy("player_id", "season").agg(
        F.sum("n").alias("shot_attempts"), F.sum("h").alias("shot_makes"), *[share("zone", z).alias(f"{z}_frequency") for z in ("rim", "paint", "midrange", "three_point")],
        *[share("action", a).alias(f"{a}_frequency") for a in ("dunk", "layup", "floater", "hook", "pull_up", "step_back")], (F.sum("d") / F.sum("n")).alias("average_shot_distance"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - expected)).alias("shot_difficulty_index"), (F.sum("h") / F.sum("n") - expected).alias("shot_making_above_expected"),
    )
    profile.write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.parquet(path), counts


def rebuild(games: DataFrame, path: str, stats: Sequence[str]) -> DataFrame:
    """Stored games without rows of no activity, types repaired, written anew at path (never over their own files)."""
    active = F.greatest(F.lit(0.0), *[F.abs(F.coalesce(finite(F.col(c)), F.lit(0.0))) for c in stats]) > 0
    kept = games.filter((F.coalesce("minutes", F.lit(0.0)) > 0) | active)
    inside = (F.col("season") == "2023-24") & (F.col("season_type") == "other") & F.col("game_date").cast("date").between(F.lit("2023-11-03").cast("date"), F.lit("2023-12-08").cast("date")) & (F.col("opponent") != "N/A")
    kept = kept.withColumn("season_type", F.when(F.coalesce(inside, F.lit(False)), "regular").otherwise(F.col("season_type")))
    return write_partitions(kept, path)


def normalise_impact(records: DataFrame) -> DataFrame:
    """Impact ratings by season label and player: text ids and end years parsed, box and on-off sums added, the last of each key kept.

    The order that decides is `order` if records has it, else all columns.
    """
    require_columns(records, {"nba_id", "player_name", "season", "dpm", "o_dpm", "d_dpm"}, "impact history")
    number = lambda c: finite(F.col(c).cast("string").try_cast("double"))
    numeric = [c for c in records.columns if c.endswith("dpm") or c.endswith("_rank")]
    df = records.withColumns({"player_id": number("nba_id").cast("long"), "season": labels.season_ending(number("season").cast("int")), **{c: number(c) for c in numeric}}).drop("nba_id")
    for name, a, b in (("box_dpm", "box_odpm", "box_ddpm"), ("on_off_dpm", "on_off_odpm", "on_off_ddpm")):
        if {a, b} <= set(numeric):
            df = df.withColumn(name, F.col(a) + F.col(b))
    df = df.filter(F.col("season").isNotNull() & F.col("player_id").isNotNull())
    order = ["order"] if "order" in df.columns else [c for c in df.columns if c not in ("season", "player_id")]
    return keep_last(df, ["season", "player_id"], order).drop("order")


def player_profiles(players: DataFrame, seasons: DataFrame, shots: DataFrame) -> DataFrame:
    """Each player's latest season with per-game and shooting rates from the shot profile; a long-range share without tries is null."""
    c = F.col
    latest = keep_last(seasons, ["player_id"], ["season"])
    out = players.join(latest, "player_id").join(shots, ["player_id", "season"], "left")
    per = lambda x: F.try_divide(x * 1.0, F.nullif(c("games_played"), F.lit(0)))
    two_made, two_tried = c("shot_makes") - c("three_point_makes"), c("shot_attempts") - c("three_point_attempts")
    out = out.withColumns({
        "field_goals_made_per_game": per(c("shot_makes")), "field_goal_attempts_per_game": per(c("shot_attempts")), "three_points_made_per_game": per(c("three_point_makes")), "three_point_attempts_per_game": per(c("three_point_attempts")),
        "two_points_made_per_game": per(two_made), "two_point_attempts_per_game": per(two_tried), "two_point_percentage": F.try_divide(two_made * 1.0, F.nullif(two_tried, F.lit(0))),
        "effective_field_goal_percentage": F.try_divide(c("shot_makes") + 0.5 * c("three_point_makes"), F.nullif(c("shot_attempts"), F.lit(0))),
    })
    return out.withColumn("three_point_percentage", F.when(F.coalesce("three_point_attempts_per_game", F.lit(0.0)) != 0, c("three_point_percentage")))


def team_stints(games: DataFrame, teams: Sequence[str] | None = None) -> DataFrame:
    """Minutes, games and last day of each player with each team of a season; only known teams and played games."""
    rows = games.filter(F.coalesce(finite(F.col("minutes")), F.lit(0.0)) > 0)
    rows = rows.filter(F.col("team").isin(*teams)) if teams else rows
    return rows.groupBy("season", "team", "player_id").agg(F.sum("minutes").alias("team_minutes"), F.countDistinct("game_id").alias("games_with_team"), F.max("game_date").alias("last_game_date"))


def primary_stints(stints: DataFrame) -> DataFrame:
    """The latest stint of each player of a season (by last day, then minutes, then team)."""
    return keep_last(stints, ["season", "player_id"], ["last_game_date", "team_minutes", "team"])


def season_team(games: DataFrame) -> DataFrame:
    """The last named team of each player in each season."""
    named = games.filter(F.trim(F.coalesce("team", F.lit(""))) != "")
    return named.groupBy("season", "player_id").agg(F.max_by("team", F.struct("game_date", "game_id")).alias("team"))


def last_seasons(rows: DataFrame, most: int = 3, least: int = 2) -> DataFrame:
    """The last `most` seasons of each player that has at least `least` of them."""
    w = Window.partitionBy("player_id")
    out = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc("season")))).filter(F.col("_r") <= most)
    return out.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least).drop("_r", "_n")
