"""Results that must not hang on the order in which rows are added up."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyforge.functions.ratios import exact_sum, scaled_round


def test_halves_round_as_in_sql(spark):
    """73.5 / 60 is 1.225, of which the SQL's hundredfold is above 122.5; averages of cents don't hang on their order."""
    rows = spark.createDataFrame([(1.225, 41.75, 2.5)], "a double, b double, c double")
    assert tuple(rows.select(scaled_round(F.col("a"), 2), scaled_round(F.col("b"), 1), scaled_round(F.col("c"), 0)).first()) == (1.23, 41.8, 2.0)


def test_sums_do_not_hang_on_order(spark):
    """copies of a customer have equal totals, in whatever parts their orders come."""
    cents = [(i * 7919 % 100003) / 100 for i in range(1, 4001)]
    sums = {spark.createDataFrame([(x,) for x in order], "x double").repartition(n).agg(exact_sum(F.col("x"))).first()[0] for n, order in ((1, cents), (3, cents[::-1]), (7, sorted(cents)))}
    assert sums == {math.fsum(cents)}
    odd = spark.createDataFrame([("a", 1e300), ("a", 1.0), ("b", None), ("c", float("nan")), ("d", 1e-12), ("d", 1.0)], "k string, x double")
    found = {r["k"]: r["s"] for r in odd.groupBy("k").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert found["a"] == 1e300 and found["b"] is None and math.isnan(found["c"]) and found["d"] == 1.0 + 1e-12


def test_minutes_of_a_season_are_the_sum(spark):
    """F8: games that come to so many minutes tie with one of as many, which games times the mean of a game may not."""
    from tallyforge.operators import features

    assert 115 / 7 * 7 != 115
    cols = ["points", "field_goal_attempts", "three_point_attempts", "free_throw_attempts", "assists", "turnovers", "offensive_rebounds", "defensive_rebounds", "steals", "blocks", "field_goals_made", "three_points_made"]
    one = lambda p, games: (p, "1999-00", games, 115 / games, 115.0, 0.5, 0.3, 0.4, *[3.0] * len(cols))
    names = ["player_id", "season", "games_played", "minutes_per_game", "minutes_total", "effective_field_goal_percentage", "three_point_percentage", "two_point_percentage", *[f"{c}_total" for c in cols]]
    rows = spark.createDataFrame([one(1, 7), one(2, 1)], names)
    traits = features.player_vectors(rows).select("trait_ball_security").collect()
    assert traits[0] == traits[1]


def test_ranges_are_cut_once(spark, monkeypatch):
    """cuts that come out otherwise when they are worked out again must not part the counts from the sums of the ranges."""
    import random

    from tallyforge.operators import windows

    class Moved:
        """Functions of Spark, with cuts that differ each time, as a merge in another order makes them."""

        def __getattr__(self, name):
            return getattr(F, name)

        def percentile_approx(self, *_):
            return F.udf(lambda n: sorted(random.SystemRandom().uniform(0, n) for _ in range(5)), "array<double>").asNondeterministic()(F.count("*"))

    monkeypatch.setattr(windows, "F", Moved())
    found = windows.cumulative(spark.range(2000).select((F.col("id") * 1.0).alias("x")), "x", ranges=6).collect()
    assert {r["v"]: r["upto"] for r in found} == {float(i): i + 1 for i in range(2000)}
