"""Sequences of timed events: where they begin, how long they run, and rates over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.ratios import ratio


def clock_seconds(clock: Column) -> Column:
    """PT11M40.00S -> 700.0"""
    pattern = r"PT(\d+)M([\d.]+)S"
    part = lambda i: F.nullif(F.regexp_extract(clock, pattern, i), F.lit("")).try_cast("double")
    return part(1) * 60 + part(2)


def sequences(rows: DataFrame, group: Sequence[str], order: str, holder: str, restart: Column, left: str) -> DataFrame:
    """Numbers possessions and times the rows in them.

    One begins when the holder changes or at a restart; its clock begins with the row before (with its own at a restart).
    Adds sequence, elapsed, limit (14 after a restart, else 24), timed (0 <= elapsed <= limit). `left` counts down.
    """
    w = Window.partitionBy(*group).orderBy(order)
    r = rows.withColumn("_restart", F.coalesce(restart, F.lit(False))).withColumn("_prev", F.lag(left).over(w))
    r = r.withColumn("_new", F.col("_restart") | F.coalesce(F.col(holder) != F.lag(holder).over(w), F.lit(True)))
    r = r.withColumn("sequence", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*group, "sequence")
    mark = F.when(F.col("_new"), F.when(F.col("_restart"), F.col(left)).otherwise(F.coalesce("_prev", left)))
    r = r.withColumn("elapsed", F.max(mark).over(s) - F.col(left))
    r = r.withColumn("limit", F.when(F.max(F.col("_restart").cast("int")).over(s) == 1, 14.0).otherwise(24.0))
    return r.withColumn("timed", F.coalesce(F.col("elapsed").between(0, F.col("limit")), F.lit(False))).drop("_restart", "_prev", "_new")


def phase_rates(timed: DataFrame, key: Sequence[str], early: float = 6.0, late: float = 4.0) -> DataFrame:
    """Shares of timed rows in the first and the last seconds of their sequences."""
    n = F.count_if("timed")
    first, last = F.count_if(F.col("timed") & (F.col("elapsed") <= early)), F.count_if(F.col("timed") & (F.col("limit") - F.col("elapsed") <= late))
    return timed.groupBy(*key).agg(n.alias("timed_rows"), ratio(first, n).alias("early_rate"), ratio(last, n).alias("late_rate"))


def action_rates(actions: DataFrame) -> DataFrame:
    """Per player and season: how shots came about and how balls were lost; small samples are null."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = actions.filter((F.col("_season_type") == "rg") & (F.col("possession") > 0)).withColumns({"kind": low("actionType"), "sub": low("subType"), "q": low("qualifiers"), "left": clock_seconds(F.col("clock"))})
    rows = sequences(rows, ["gameId", "period"], "orderNumber", "possession", (F.col("kind") == "rebound") & (F.col("sub") == "offensive"), "left")
    shot, lost = F.col("kind").isin("2pt", "3pt"), F.col("kind") == "turnover"
    made = shot & (low("shotResult") == "made")
    has = lambda t: shot & F.contains(F.col("q"), F.lit(t))
    timed = shot & F.col("timed")
    counts = {
        "shots": shot, "makes": made, "assisted": made & F.col("assistPersonId").isNotNull(), "fastbreak": has("fastbreak"), "second_chance": has("2ndchance"),
        "from_turnover": has("fromturnover"), "timing": timed, "early": timed & (F.col("elapsed") <= 6), "late": timed & (F.col("limit") - F.col("elapsed") <= 4),
        "turnovers": lost, "bad_pass": lost & F.contains(F.col("sub"), F.lit("bad pass")), "lost_ball": lost & F.contains(F.col("sub"), F.lit("lost ball")),
    }
    out = rows.groupBy(F.col("personId").alias("player_id"), F.col("_season").alias("season_start")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).filter("shots > 0")
    rates = {"fastbreak_rate": ("fastbreak", "shots"), "second_chance_rate": ("second_chance", "shots"), "from_turnover_rate": ("from_turnover", "shots"), "early_rate": ("early", "timing"), "late_rate": ("late", "timing")}
    out = out.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in rates.items()})
    out = out.withColumn("assisted_rate", F.when(F.col("makes") >= 40, ratio(F.col("assisted"), F.col("makes"))))
    enough = F.col("turnovers") >= 20
    return out.withColumns({"bad_pass_share": F.when(enough, ratio(F.col("bad_pass"), F.col("turnovers"))), "lost_ball_share": F.when(enough, ratio(F.col("lost_ball"), F.col("turnovers")))})
