"""Features, needs, styles, forecasts and texts by hand or against numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import names, text
from tallyforge.operators import evaluate, events, evidence, features, forecast, style, team, windows
from tallyforge.plans.queries import QUERIES
from tallyforge.plans.styles import network
from tallyforge.sources import archive
from tallyforge.sources.schema import MATCHUPS, snake_case


def test_running_counts_make_ranks_and_quantiles_as_pandas_does(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"i": range(900), "g": rng.integers(0, 3, 900), "x": rng.integers(0, 60, 900).astype(float), "y": rng.normal(size=900)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = {r["i"]: r for r in windows.percentiles(df, ["i"], {"x": True, "y": False}, ["g"]).collect()}
    x = pdf.groupby("g")["x"].rank(pct=True).fillna(0.5)
    y = pdf.groupby("g")["y"].rank(pct=True, ascending=False)
    assert [got[i]["pct_x"] for i in pdf["i"]] == pytest.approx(x.tolist())
    assert [got[i]["pct_y"] for i in pdf["i"]] == pytest.approx(y.tolist())
    q = {r["g"]: (r["q0"], r["q1"]) for r in windows.exact_quantiles(df, "x", [0.5, 0.8], ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert q[g] == pytest.approx(tuple(part["x"].quantile([0.5, 0.8])))
    assert windows.exact_quantiles(df.limit(0), "x", [0.5]).count() <= 1


def test_team_seasons_of_two_mirrored_games(spark):
    base = {c: 0.0 for c in features.TEAM_COUNTS}
    a = base | {"team_score": 110.0, "field_goals_attempted": 80.0, "field_goals_made": 40.0, "three_pointers_made": 12.0, "turnovers": 10.0}
    b = base | {"team_score": 100.0, "field_goals_attempted": 85.0, "field_goals_made": 38.0, "three_pointers_made": 8.0, "turnovers": 14.0}
    rows = [dict(a, season="2024-25", game_id="1", team_id=1, opponent_team_id=2, team="A", opponent_score=100.0), dict(b, season="2024-25", game_id="1", team_id=2, opponent_team_id=1, team="B", opponent_score=110.0), dict(b, season="2024-25", game_id="2", team_id=3, opponent_team_id=9, team=" ", opponent_score=1.0)]
    got = {r["team"]: r for r in features.team_seasons(spark.createDataFrame(pd.DataFrame(rows))).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"]["wins"], got["A"]["league_rank"], got["B"]["league_rank"]) == (1, 1, 2)
    assert got["A"]["effective_field_goal_percentage"] == pytest.approx(46 / 80)
    assert got["A"]["offensive_rating"] > got["A"]["defensive_rating"]
    assert got["A"]["opponent_effective_field_goal_percentage"] == pytest.approx(got["B"]["effective_field_goal_percentage"])


def test_matchups_weigh_positions_and_heights(spark):
    rows = [(7, 1, "G", 1, 60.0, 20, 5, 3, 2, 1, 2024, "rg"), (7, 2, None, 2, 40.0, 10, 5, 3, 0, 1, 2024, "rg"), (7, 2, None, 3, 99.0, 10, 5, 3, 0, 1, 2024, "po")]
    people = spark.createDataFrame([(1, 1, 0, 0, 76.0), (2, 0, 0, 1, 80.0)], "player_id long, guard int, forward int, center int, height double")
    r = features.matchup_profiles(spark.createDataFrame(rows, MATCHUPS), people).first()
    assert (r["matchup_guard_share"], r["matchup_center_share"], r["matchup_height"]) == pytest.approx((0.6, 0.4, 77.6))
    assert r["matchup_games"] == 2 and r["season"] == "2024-25"


def test_shot_context_needs_both_sides(spark):
    rows = [(1, "s", "rim", i % 2 == 0, 1 + 3 * (i % 2), "rg") for i in range(4)]
    df = spark.createDataFrame(rows, "player_id long, season string, zone string, home boolean, period int, season_type string")
    r = features.shot_context(df).first()
    assert not r["home_away_eligible"] and not r["quarter_eligible"] and r["home_away_shift"] is None
    assert features.shot_context(df, least=2).first()["home_away_shift"] == 0


def test_elite_model_prefers_what_wins(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(3):
        x = rng.normal(size=(12, 15))
        for t, place in enumerate(np.argsort(np.argsort(-x[:, 0]))):
            rows.append((f"200{s}-0{s + 1}", t, f"T{t}", 82, 40, 0.5, 1.0, 1.0, *map(float, x[t]), 0.0, int(place) + 1))
    schema = "season string, team_id long, team string, games long, wins long, win_percentage double, offensive_rating double, defensive_rating double, " + ", ".join(f"{c} double" for c in features.TEAM_FEATURES) + ", net_rating double, league_rank int"
    df = spark.createDataFrame(rows, schema)
    _, _, found = team.elite_model(df, top_n=4)
    first = features.TEAM_FEATURES[0]
    assert found[first] > 0 and found[first] == max(found.values(), key=abs)
    gaps = {r["feature"]: r for r in team.needs(df, "2002-03", 0, found, top_n=4, lookback=2).collect()}
    assert len(gaps) == 15 and sum(r["importance"] for r in gaps.values()) == pytest.approx(1)
    assert team.needs(df, "2002-03", 99, found).count() == 0


def test_no_gap_gives_no_candidates(spark):
    gaps = spark.createDataFrame([("pace", "transition_play", 0.0)], "feature string, trait string, priority double")
    traits = spark.createDataFrame([(1, 50, 30.0, "B", "G", 10.0, 0.5)], "player_id long, games_played long, minutes_per_game double, team string, position string, points_per_game double, trait_transition_play double")
    assert team.recommend(traits, team.trait_weights(gaps), "A").count() == 0


def test_action_rates_of_six_shots(spark):
    rows = [("2pt", "", "fastbreak", 7, 1.0, 5, i, "PT11M40.00S", 1, 9, "Made", 2024, "rg") for i in range(1, 3)] + [("2pt", "", "", 7, None, 5, 3, "PT11M40.00S", 1, 9, "Missed", 2024, "rg")]
    df = spark.createDataFrame(rows, "actionType string, subType string, qualifiers string, personId long, assistPersonId double, possession long, orderNumber long, clock string, period int, gameId long, shotResult string, _season int, _season_type string")
    r = events.action_rates(df).first()
    assert r["fastbreak_rate"] == pytest.approx(2 / 3) and r["assisted_rate"] is None and r["shots"] == 3


def test_frozen_networks_as_numpy(spark, sf_dir):
    net = network()
    rows = spark.createDataFrame([(i, *[None if (i + j) % 5 == 0 else float(np.sin(i * 3 + j)) for j in range(4)]) for i in range(30)], "k long, f0 double, f1 double, f2 double, f3 double")
    got = {r["k"]: r["v"] for r in style.mlp_encoder(rows, ["k"], net).collect()}
    def enc(x):
        x = np.array([m if v is None else v for v, m in zip(x, net["median"], strict=True)])
        x = (x - net["mean"]) / np.where(np.array(net["scale"]) == 0, 1, net["scale"])
        for i, (w, b) in enumerate(net["layers"]):
            x = w @ x + b
            if i < 2:
                x = np.array([0.5 * z * (1 + math.erf(z / math.sqrt(2))) for z in x])
        return x / np.linalg.norm(x)
    want = {r["k"]: enc(list(r)[1:]) for r in rows.collect()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v.tolist())
    pairs = spark.createDataFrame([(1, 2), (3, 3)], "a long, b long")
    found = style.pair_attribution(pairs, rows, "a", "b", "k", net).collect()
    assert len(found) == 8
    same = [r for r in found if r["a"] == 3]
    assert all(r["score"] == pytest.approx(1) and r["apart"] == pytest.approx(0, abs=1e-9) for r in same)
    one = next(r for r in found if r["a"] == 1)
    assert one["score"] == pytest.approx(1 - math.acos(float(want[1] @ want[2])) / math.pi)


def test_neighbours_of_a_query_without_impact_are_an_error(spark):
    rows = spark.createDataFrame([(0, 1, "G", None, [1.0, 0.0]), (1, 2, "G", 1.0, [1.0, 0.1])], "vec_id long, player long, position string, impact double, v array<double>")
    with pytest.raises(Exception, match="no impact"):
        style.style_neighbors(rows.filter("vec_id = 0"), rows, n=3, impact="impact", tolerance=1.0).collect()
    assert style.style_neighbors(rows.filter("vec_id = 0"), rows, n=3).first()["vec_id"] == 1


def test_calibrators_as_newton_in_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(s, float(x), int(rng.binomial(82, 1 / (1 + math.exp(-0.1 * x)))), 82) for s in range(4) for x in rng.normal(scale=5, size=12)]
    r = forecast.calibrator_errors(spark.createDataFrame(rows, "season long, net double, won long, games long"), "season", "net", "won", "games").first()
    errors = []
    for s in range(4):
        d = np.array([q[1:] for q in rows if q[0] != s])
        a = b = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * d[:, 0] + b)))
            g = np.array([((d[:, 1] - d[:, 2] * p) * d[:, 0]).sum(), (d[:, 1] - d[:, 2] * p).sum()])
            h = d[:, 2] * p * (1 - p)
            step = np.linalg.solve([[(h * d[:, 0] ** 2).sum(), (h * d[:, 0]).sum()], [(h * d[:, 0]).sum(), h.sum()]], g)
            a, b = a + step[0], b + step[1]
        errors += [abs(82 / (1 + math.exp(-(a * q[1] + b))) - q[2]) for q in rows if q[0] == s]
    assert r["bounded_mae"] == pytest.approx(np.mean(errors), abs=1e-6)


def test_dealt_labels_are_a_permutation(spark, sf_dir):
    rows = spark.createDataFrame([(i, i % 3) for i in range(200)], "k long, label int")
    out = forecast.permuted_labels(rows, "k", "label", 3).toPandas()
    for _, part in out.groupby("permutation"):
        assert sorted(part["k"]) == list(range(200))
        assert sorted(part["label"]) == sorted(i % 3 for i in range(200))
        assert 20 < (part["label"] == part["k"] % 3).sum() < 120
    ev = QUERIES["paired_evidence"](spark, sf_dir).first()
    assert ev["low"] <= ev["mean_delta"] <= ev["high"]


def test_simulated_rosters_reject_the_unknown(spark):
    pool = spark.createDataFrame([(1, 30.0), (2, 0.0)], "player_id long, minutes_per_game double")
    picks = "roster string, player_id long, override double"
    with pytest.raises(Exception, match="pool has not"):
        forecast.simulated_roster(pool, spark.createDataFrame([("a", 5, None)], picks), "roster").collect()
    with pytest.raises(Exception, match="no minutes"):
        forecast.simulated_roster(pool, spark.createDataFrame([("a", 2, None)], picks), "roster").collect()


def test_numbers_of_a_report_have_support(spark):
    df = spark.createDataFrame([("He scored 12.3 and 46.2% of 7, fell by -3, not x9 nor 1.25", '{"a": 7, "b": -3}')], "t string, p string")
    r = df.select(text.unsupported(F.col("t"), F.col("p"), F.array(F.lit(12.34), F.lit(0.462))).alias("u"), text.numbers(F.col("t")).alias("n")).first()
    assert r["n"] == ["12.3", "46.2", "7", "-3", "1.25"] and r["u"] == ["1.25"]


def test_searches_and_long_range(spark):
    rows = spark.createDataFrame([(1, "Ann Lee", "A"), (2, "Bo Leeman", "B")], "k long, name string, team string")
    found = names.resolve(rows, "B", "name", "lee", ascii_only=True).collect()
    assert sorted(r["k"] for r in found) == [1, 2] and all(r["league_wide"] for r in found)  # a whole word elsewhere beats a word's start here
    assert [r["k"] for r in names.resolve(rows, "A", "name", "lee", ascii_only=True).collect()] == [1]
    assert names.within(rows, None, "name", " LEE ").count() == 2 and names.within(rows, "A", "name", "").count() == 1
    r = spark.createDataFrame([(25, 5), (24, 9), (None, None)], "t int, m int").select(evidence.reliable_long_range(F.col("t"), F.col("m")).alias("ok")).collect()
    assert [x["ok"] for x in r] == [True, False, False]


def test_names_of_columns_and_absent_archives(spark, tmp_path):
    assert [snake_case(c) for c in ("gameDateTimeEst", "playerteamId", "teamId", "reboundsTotal", "q1Points")] == ["game_datetime_est", "playerteam_id", "team_id", "rebounds_total", "q1_points"]
    assert archive.read_coverage(spark, f"{tmp_path}/none").count() == 0 and not archive.available(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match="no season"):
        archive.season_games(spark.range(1), "season")


def test_ranking_quality_without_positives(spark):
    r = evaluate.ranking_quality(spark.createDataFrame([(0.5, 0), (0.2, 0)], "s double, y int"), "s", "y").first()
    assert r["roc_auc"] is None and r["average_precision"] is None
