"""Scans over directories of event files whose columns differ, live rows over history, and team games with types repaired."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.operators import aggregate
from tallyforge.operators.joins import align
from tallyforge.sources.archive import available, keep_last, write_partitions
from tallyforge.sources.schema import require_columns

#: Keys that a filter lists by itself; more are a table that the scan is joined to.
LISTED = 1000


def scan_events(
    spark: SparkSession, path: str, schema: str, *, optional: Iterable[str] = (), first=None, last=None, types: Sequence[str] | None = None, keys: DataFrame | Sequence | None = None,
    season: str = "_season", kind: str = "_season_type", key: str = "player_id",
) -> DataFrame:
    """All Parquet files under path as one table with the schema's columns: those a file lacks are null, others aren't read.

    A column that no file has is an error, but for optional ones, as is a path without files. Seasons (first to last), types and keys are filters that reach the
    files, or the folders where they are partitions; keys as a table become a semi join. Files that have a column have it in one type.
    """
    if not available(spark, path):
        raise ValueError(f"there is nothing at {path}")
    wanted = spark.createDataFrame([], schema).schema
    found = spark.read.option("mergeSchema", True).parquet(path)  # footers only, read by tasks
    require_columns(found, set(wanted.names) - set(optional), path)
    rows = spark.read.schema(wanted).parquet(path).select(*wanted.names)
    if first is not None:
        rows = rows.filter(F.col(season) >= F.lit(first))
    if last is not None:
        rows = rows.filter(F.col(season) <= F.lit(last))
    if types is not None:
        rows = rows.filter(F.col(kind).isin(*types))
    if isinstance(keys, DataFrame):
        return rows.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi").select(*wanted.names)
    if keys is not None and len(keys) > LISTED:
        return rows.join(spark.createDataFrame([(k,) for k in keys], [key]).distinct(), key, "left_semi").select(*wanted.names)
    return rows if keys is None else rows.filter(F.col(key).isin(*keys))


def live_over_history(history: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History with the rows of live in place of its own of the same keys, in history's columns: those that live lacks are null.

    Null keys are replaced by nothing. Of live rows with the same keys the last by all columns stays.
    """
    new = keep_last(live, keys, [c for c in live.columns if c not in keys] or list(keys))
    return history.join(new.select(*keys), list(keys), "left_anti").select(*history.columns).unionByName(align(new, history))


def player_seasons(history: DataFrame, live: DataFrame | None, impact: DataFrame, *, keys: Sequence[str] = ("season", "player_id"), order: Sequence[str] = ("updated",)) -> DataFrame:
    """History with live rows over it, and of impact the last row of each key by `order`; players without one keep nulls."""
    rows = history if live is None else live_over_history(history, live, keys)
    return rows.join(keep_last(impact, keys, order).drop(*order), list(keys), "left")


def load_team_games(spark: SparkSession, path: str, *, first: str = "2014-15", last: str | None = None) -> DataFrame:
    """Regular games of a range of seasons: those stored as such, and those of unknown type whose game id says so.

    Season and type are folders, so other ones aren't read. Of the rows of a season, game and team the last by date stays. A path without folders of
    the range is an error.
    """
    if not available(spark, path):
        raise ValueError(f"there is nothing at {path}")
    rows = spark.read.parquet(path).filter(F.col("season_type").isin("regular", "unknown") & (F.col("season") >= first))
    rows = rows if last is None else rows.filter(F.col("season") <= last)
    if rows.limit(1).isEmpty():
        raise ValueError(f"{path} has no seasons from {first} to {last or 'the end'}")
    regular = (F.col("season_type") == "regular") | (labels.game_id_type(F.col("game_id")) == "regular")
    rows = rows.filter(regular).withColumnRenamed("season_type", "stored_season_type")
    others = [c for c in rows.columns if c not in ("season", "game_id", "team_id", "game_date")]
    return keep_last(rows, ["season", "game_id", "team_id"], ["game_date", *others])


def rebuild_totals(games: DataFrame, path: str, stats: Sequence[str], observed: str = "minutes") -> DataFrame:
    """Season totals and rates of each player from the regular games of an archive, written by season; returns what was written.

    observed is averaged over the games in which it was noted.
    """
    regular = games.filter(F.col("season_type") == "regular")
    totals = aggregate.finish(aggregate.partials(regular, ["season", "player_id"], stats, observed), stats, observed)
    write_partitions(totals, path, ["season"])
    return games.sparkSession.read.parquet(path)
