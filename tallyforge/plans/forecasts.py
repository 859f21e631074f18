"""Queries over forecasts and their evaluation. Suppliers stand in for rosters, customers for history, orders for results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.ratios import exact_sum, ratio, scaled_round
from tallyforge.operators import forecast, windows
from tallyforge.plans.base import query, read
from tallyforge.plans.players import _rounded

ROSTER = "WITH r AS (SELECT s_suppkey, s_acctbal / 10000 AS rq, (s_suppkey % 10) / 10.0 AS tq FROM supplier)"
CURVE = (0.11, 0.02)
W = "82 / (1 + exp(-(0.11 * ({x}) + 0.02)))"


def _rosters(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("rotation_quality"), ((F.col("s_suppkey") % 10) / 10.0).alias("top_three_quality"))


@query("talent_summary", ROSTER + """, h AS (SELECT 0.65 * c_acctbal / 10000 + 0.35 * (c_custkey % 10) / 10.0 AS t FROM customer)
SELECT s_suppkey, round(0.65 * rq + 0.35 * tq, 8) AS talent_index, round(100 * (SELECT count(*) FROM h WHERE h.t <= 0.65 * rq + 0.35 * tq) / (SELECT count(*) FROM h), 8) AS historical_percentile, round((SELECT min(t) FROM h), 8) AS historical_min, round((SELECT max(t) FROM h), 8) AS historical_max FROM r""")
def talent_summary(spark, sf):
    history = read(spark, sf, "customer").select((F.col("c_acctbal") / 10000).alias("rotation_quality"), ((F.col("c_custkey") % 10) / 10.0).alias("top_three_quality"))
    return _rounded(forecast.talent_summary(_rosters(spark, sf), history, "s_suppkey"), ["s_suppkey"], 8)


NET = "20 * rq - 8 * tq"


@query("roster_forecast", ROSTER + f", n AS (SELECT *, {NET} AS net, 30 * (0.65 * rq + 0.35 * tq) - 12 AS top FROM r) SELECT s_suppkey, round(net, 8) AS net_rating, round(net - 2.7, 8) AS net_rating_low, round(net + 2.7, 8) AS net_rating_high, round({W.format(x='net')}, 8) AS expected_wins, round({W.format(x='net - 2.7')}, 8) AS wins_low, round({W.format(x='net + 2.7')}, 8) AS wins_high, round(top, 8) AS ceiling_net_rating, round({W.format(x='top')}, 8) AS ceiling_wins, CAST(round_even({W.format(x='top')}, 0) AS INTEGER) AS display_wins FROM n")
def roster_forecast(spark, sf):
    rows = _rosters(spark, sf).withColumn("net_rating", 20 * F.col("rotation_quality") - 8 * F.col("top_three_quality"))
    out = forecast.ceiling_forecast(forecast.quality_forecast(rows, "net_rating", 2.7, *CURVE), (30.0, -12.0), *CURVE)
    return _rounded(out.drop("rotation_quality", "top_three_quality"), ["s_suppkey"], 8)


@query("anchored_forecast", ROSTER + f""", n AS (SELECT s_suppkey, {NET} AS net, {NET} - 1.5 AS base, 10 * rq - 4 AS obs, s_suppkey % 60 AS won, 60 + s_suppkey % 23 AS games FROM r), k AS (SELECT *, obs + net - base AS anc, 82 * won / games + ({W.format(x='net')}) - ({W.format(x='base')}) AS ew FROM n), z AS (SELECT *, abs({W.format(x='anc + 2.7')} - {W.format(x='anc')}) AS sp FROM k)
SELECT s_suppkey, round(anc, 8) AS anchored_net_rating, round(least(82, greatest(0, ew)), 8) AS anchored_wins, round(least(82, greatest(0, ew - sp)), 8) AS anchored_wins_low, round(least(82, greatest(0, ew + sp)), 8) AS anchored_wins_high, round(net - base, 8) AS model_delta FROM z""")
def anchored_forecast(spark, sf):
    c = F.col
    net = 20 * c("rotation_quality") - 8 * c("top_three_quality")
    rows = _rosters(spark, sf).select("s_suppkey", net.alias("net_rating"), (net - 1.5).alias("base_net_rating"), (10 * c("rotation_quality") - 4).alias("observed_net_rating"), (c("s_suppkey") % 60).alias("observed_wins"), (60 + c("s_suppkey") % 23).alias("observed_games"))
    rows = rows.withColumns({"expected_wins": forecast.wins(c("net_rating"), *CURVE), "base_expected_wins": forecast.wins(c("base_net_rating"), *CURVE)})
    out = forecast.anchored(rows, 2.7, *CURVE)
    return _rounded(out.select("s_suppkey", "anchored_net_rating", "anchored_wins", "anchored_wins_low", "anchored_wins_high", "model_delta"), ["s_suppkey"], 8)


@query("trait_changes", "WITH b AS (SELECT c_custkey, unnest(['a', 'b', 'c']) AS trait, unnest([c_acctbal / 1000, c_custkey % 7, c_custkey % 5]) AS baseline, unnest([c_acctbal / 900, c_custkey % 6, c_custkey % 5 + 1]) AS simulated FROM customer) SELECT c_custkey, trait, round(baseline, 8) AS baseline, round(simulated, 8) AS simulated, round(simulated - baseline, 8) AS change, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(simulated - baseline) DESC, trait) AS place FROM b")
def trait_changes(spark, sf):
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    base = c.select(k, (F.col("c_acctbal") / 1000).alias("a"), (k % 7).cast("double").alias("b"), (k % 5).cast("double").alias("c"))
    new = c.select(k, (F.col("c_acctbal") / 900).alias("a"), (k % 6).cast("double").alias("b"), (k % 5 + 1).cast("double").alias("c"))
    out = forecast.trait_changes(base, new, "c_custkey", ["a", "b", "c"])
    return _rounded(out.withColumn("place", F.col("place").cast("long")), ["c_custkey", "trait"], 8)


@query("simulated_rosters", """WITH p AS (SELECT c_nationkey || '/' || (c_custkey // 375) AS roster, c_custkey AS player_id, CASE WHEN c_custkey % 6 = 0 THEN 30.0 ELSE greatest(0, c_acctbal / 250) END AS w FROM customer), o AS (SELECT *, row_number() OVER (PARTITION BY roster ORDER BY w DESC, player_id) - 1 AS k, sum(w) OVER (PARTITION BY roster ORDER BY w DESC, player_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM p),
f AS (SELECT *, CASE WHEN coalesce(greatest(0, 240 - 48 * k) * w / nullif(rest, 0), 0) < 48 THEN k END AS free FROM o), h AS (SELECT *, coalesce(min(free) OVER (PARTITION BY roster), count(*) OVER (PARTITION BY roster)) AS capped FROM f), l AS (SELECT *, max(CASE WHEN k = capped THEN rest END) OVER (PARTITION BY roster) AS lft FROM h)
SELECT roster, player_id, round(w, 8) AS rotation_weight, round(CASE WHEN w <= 0 THEN 0 WHEN k < capped THEN 48 ELSE (240 - 48 * capped) * w / lft END, 6) AS normalized_minutes FROM l WHERE (SELECT sum(w) FROM p q WHERE q.roster = l.roster) > 0""")
def simulated_rosters(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), F.format_string("%d/%d", "c_nationkey", F.floor(F.col("c_custkey") / 375)).alias("roster"), (F.col("c_acctbal") / 250).alias("minutes_per_game"))
    picks = c.select("roster", "player_id", F.when(F.col("player_id") % 6 == 0, 30.0).alias("override"))
    weighted = c.withColumn("w", F.when(F.col("player_id") % 6 == 0, 30.0).otherwise(F.greatest(F.lit(0.0), F.col("minutes_per_game"))))
    some = weighted.groupBy("roster").agg(F.sum("w").alias("w")).filter("w > 0").select("roster")
    out = forecast.simulated_roster(c, picks.join(some, "roster", "left_semi").unionByName(picks.join(some, "roster", "left_semi").filter("player_id % 5 = 0")), "roster")
    return out.select("roster", "player_id", F.round("rotation_weight", 8).alias("rotation_weight"), F.round("normalized_minutes", 6).alias("normalized_minutes"))


RESULTS = "WITH y AS (SELECT o_custkey % 30 AS team, year(o_orderdate) AS season, avg(o_totalprice) / 20000 - 12 AS net, count(*) FILTER (o_orderstatus = 'F') AS won, count(*) AS games FROM orders GROUP BY 1, 2)"


def _results(spark, sf):
    return read(spark, sf, "orders").groupBy((F.col("o_custkey") % 30).alias("team"), F.year("o_orderdate").cast("long").alias("season")).agg((F.avg("o_totalprice") / 20000 - 12).alias("net"), F.count_if(F.col("o_orderstatus") == "F").alias("won"), F.count("*").alias("games"))


@query("left_out_lines", RESULTS + ", p AS (SELECT a.team, a.season, a.net, regr_slope(82 * b.won / b.games, b.net) * a.net + regr_intercept(82 * b.won / b.games, b.net) AS p FROM y a JOIN y b ON b.season <> a.season GROUP BY 1, 2, 3) SELECT team, season, round(p, 6) AS predicted FROM p")
def left_out_lines(spark, sf):
    rows = _results(spark, sf).withColumn("y", 82 * F.col("won") / F.col("games"))
    return forecast.left_out_lines(rows, "season", "net", "y").select("team", "season", F.round("predicted", 6).alias("predicted"))


@query("calibrator_errors")
def calibrator_errors(spark, sf):
    return forecast.calibrator_errors(_results(spark, sf), "season", "net", "won", "games")


HELD = "WITH h AS (SELECT o_orderpriority AS target, o_totalprice / 1e5 AS a, (o_totalprice + (o_orderkey % 100 - 50) * 1000) / 1e5 AS p, 2.5 AS b FROM orders)"


@query("held_out_errors", HELD + " SELECT target, count(*) AS rows, round(avg(abs(a - p)), 8) AS mae, round(avg(abs(a - p)) / stddev_pop(a), 8) AS normalized_mae, round(1 - avg((a - p) ** 2) / var_pop(a), 8) AS r2, round(avg(abs(a - b)), 8) AS baseline_mae, avg(abs(a - p)) < avg(abs(a - b)) AS beats_baseline FROM h GROUP BY target")
def held_out_errors(spark, sf):
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("target"), (price / 1e5).alias("a"), ((price + (k % 100 - 50) * 1000) / 1e5).alias("p"), F.lit(2.5).alias("b"))
    return _rounded(forecast.held_out_errors(rows, "target", "a", "p", "b"), ["target"], 8)


FOLDS = "WITH m AS (SELECT o_custkey % 5 AS seed, year(o_orderdate) AS fold, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS model, avg(o_totalprice) / 1e5 AS mrr FROM orders GROUP BY 1, 2, 3)"


def _folds(spark, sf):
    return read(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).alias("seed"), F.year("o_orderdate").cast("long").alias("fold"), F.when(F.col("o_orderkey") % 2 == 0, "new").otherwise("old").alias("model")).agg((F.avg("o_totalprice") / 1e5).alias("mrr"))


@query("fold_summary", FOLDS + " SELECT model, round(avg(mrr), 8) AS mrr, round(stddev_samp(mrr), 8) AS mrr_deviation, count(*) AS folds FROM m GROUP BY model")
def fold_summary(spark, sf):
    return _rounded(forecast.fold_summary(_folds(spark, sf), ["model"], ["mrr"]), ["model"], 8)


@query("paired_folds", FOLDS + ", d AS (SELECT seed, fold, max(mrr) FILTER (model = 'new') - max(mrr) FILTER (model = 'old') AS d FROM m GROUP BY 1, 2) SELECT fold, round(avg(d), 8) AS delta FROM d WHERE d IS NOT NULL GROUP BY fold")
def paired_folds(spark, sf):
    return _rounded(forecast.paired_folds(_folds(spark, sf), "model", "new", "old", "mrr"), ["fold"], 8)


@query("paired_evidence")
def paired_evidence(spark, sf):
    return forecast.paired_evidence(forecast.paired_folds(_folds(spark, sf), "model", "new", "old", "mrr"), "fold")


@query("baseline_gate", FOLDS + " SELECT model, fold, round(avg(mrr), 8) AS mean, CAST(2.5 AS DOUBLE) AS baseline, avg(mrr) >= 2.5 - 0.05 AS passed FROM m GROUP BY 1, 2")
def baseline_gate(spark, sf):
    rows = _folds(spark, sf)
    stored = rows.select("model", "fold").distinct().withColumn("mrr", F.lit(2.5))
    return _rounded(forecast.gate(rows, ["model", "fold"], "mrr", stored, 0.05), ["model", "fold"], 8)


@query("permutation_null")
def permutation_null(spark, sf):
    """How often a vector keeps its label when labels are dealt anew: the level that chance reaches."""
    rows = read(spark, sf, "embeddings").select("vec_id", "label")
    dealt = forecast.permuted_labels(rows, "vec_id", "label", 20).withColumnRenamed("label", "dealt")
    each = dealt.join(rows, "vec_id").groupBy("permutation").agg(F.avg(F.when(F.col("label") == F.col("dealt"), 1.0).otherwise(0.0)).alias("kept"))
    return each.select("permutation", "kept")


@query("game_summary", "SELECT user_id, count(*) AS games, round_even(avg(value), 1) AS points, round_even(avg(coalesce((event_id % 9 + 0.5 * (event_id % 4)) / nullif(event_id % 17, 0), 0)), 3) AS effective, round_even(avg(coalesce((event_id % 5) / nullif(event_id % 3, 0), 0)), 2) AS assist_turnover_ratio FROM events GROUP BY user_id")
def game_summary(spark, sf):
    k = F.col("event_id")
    rows = read(spark, sf, "events").select("user_id", "value", ratio(k % 9 + 0.5 * (k % 4), k % 17, 0.0).alias("e"), ratio(k % 5, k % 3, 0.0).alias("at"))
    return rows.groupBy("user_id").agg(F.count("*").alias("games"), scaled_round(exact_sum(F.col("value")) / F.count("value"), 1).alias("points"), scaled_round(F.avg("e"), 3).alias("effective"), scaled_round(F.avg("at"), 2).alias("assist_turnover_ratio"))


@query("view_profiles", """WITH g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 AS parity, value FROM events), p AS (SELECT user_id, CASE WHEN parity = 1 THEN 'odd' ELSE 'even' END AS view, count(*) AS games_played, sum(value) * 3 AS minutes_total, count(*) * 4 AS shot_attempts FROM g GROUP BY 1, 2),
k AS (SELECT * FROM p WHERE games_played >= 10 AND minutes_total >= 250 AND shot_attempts >= 50) SELECT user_id, view, games_played, round(least(1, greatest(0.05, least(games_played / 25.0, minutes_total / 750.0, shot_attempts / 250.0))), 8) AS reliability FROM k WHERE user_id IN (SELECT user_id FROM k GROUP BY 1 HAVING count(DISTINCT view) = 2)""")
def view_profiles(spark, sf):
    rows = windows.halves(read(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).withColumn("view", F.when(F.col("parity") == 1, "odd").otherwise("even"))
    made = rows.groupBy("user_id", "view").agg(F.count("*").alias("games_played"), (F.sum("value") * 3).alias("minutes_total"), (F.count("*") * 4).alias("shot_attempts"))
    out = forecast.both_views(forecast.enough(made, half=True), ["user_id"])
    return _rounded(out.select("user_id", "view", "games_played", forecast.half_reliability(F.col("games_played"), F.col("minutes_total"), F.col("shot_attempts"), half=True).alias("reliability")), ["user_id", "view"], 8)


GROUPS = {"money": ["acctbal"], "place": ["nation", "segment"]}


@query("group_weights", """WITH c AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS acctbal, CAST(c_nationkey AS DOUBLE) AS nation, CAST(length(c_mktsegment) AS DOUBLE) AS segment FROM customer), w AS (SELECT sqrt(0.6) AS a, sqrt(0.4 / 2) AS b, (sqrt(0.6) + 2 * sqrt(0.4 / 2)) / 3 AS m),
z AS (SELECT c_custkey, (a / m * (acctbal - avg(acctbal) OVER ()) / stddev_pop(acctbal) OVER ()) ** 2 AS money, (b / m * (nation - avg(nation) OVER ()) / stddev_pop(nation) OVER ()) ** 2 + (b / m * (segment - avg(segment) OVER ()) / stddev_pop(segment) OVER ()) ** 2 AS place FROM c, w)
SELECT c_custkey, round(money + place, 8) AS distance, round(money / (money + place), 8) AS money_share, round(place / (money + place), 8) AS place_share FROM z""")
def group_weights(spark, sf):
    """The share that each group of features makes of a customer's weighted distance from the mean, by the groups' budgets."""
    rows = read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"), F.length("c_mktsegment").cast("double").alias("segment"))
    weights = forecast.group_weights({"money": 0.6, "place": 0.4}, GROUPS)
    return _rounded(forecast.group_shares(rows, ["c_custkey"], weights, GROUPS), ["c_custkey"], 8)
