"""Briefs and simulation texts by their rules: what is said, what is cited, and that no number comes from nowhere."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import text
from tallyforge.operators import briefs
from tallyforge.plans.queries import QUERIES

STATS = ["points_per_game", "rebounds_per_game", "assists_per_game", "turnovers_per_game", "three_point_percentage", "three_point_attempts_per_game", "three_points_made_per_game", "games_played", *[f"{x}_frequency" for x in briefs.ZONES + briefs.KINDS], "shot_making_above_expected"]
PLAIN = {"points_per_game": 16.0, "rebounds_per_game": 3.0, "assists_per_game": 6.0, "turnovers_per_game": 2.5, "three_point_percentage": 0.4, "three_point_attempts_per_game": 5.0, "three_points_made_per_game": 2.0, "games_played": 10.0}
SHOTS = {f"{z}_frequency": v for z, v in zip(briefs.ZONES + briefs.KINDS, [0.4, 0.1, 0.1, 0.4, 0.0, 0.3, 0.0, 0.3, 0.1, 0.0], strict=True)} | {"shot_making_above_expected": -0.05}


def _brief(spark, stats, position="G-F", trend=None):
    kind = T.StructType([T.StructField(c, T.StringType()) for c in ("k", "player_name", "position", "season", "trend")] + [T.StructField(c, T.DoubleType()) for c in STATS])
    row = ("a", "Pat", position, "1998-99", trend, *[stats.get(c) for c in STATS])
    return briefs.scouting_briefs(spark.createDataFrame([row], kind), "k").first()


def _part(report, heading):
    return report.split(heading + "\n")[1].split("\n\n")[0]


def test_a_brief_says_what_the_season_shows(spark):
    r = _brief(spark, PLAIN | SHOTS, trend="Points went up.")
    strong = _part(r["report"], "## Strong points")
    assert "Scores a lot: 16.0 [E1]" in strong and "Creates for others: 6.0 [E3]" in strong and "Rebounds" not in strong and "40.0% [E5]" in strong
    assert "Shoots most from: rim, 40.0% of tries [E6]" in strong and "Shoots most by: layup, 30.0% of tries [E11]" in strong  # the first of equal ones
    assert "Makes 5.0% less than" in _part(r["report"], "## Watch") and _part(r["report"], "## Lately") == "Points went up."
    fit = _part(r["report"], "## Fits best")
    assert "runs the offence" in fit and "wants shooters" in fit
    assert _part(r["report"], "## Evidence").count("- [E") == 16 == len(json.loads(r["packet"]))


def test_a_brief_without_shots_long_range_or_strengths(spark):
    few = PLAIN | {"points_per_game": 8.0, "assists_per_game": 1.0, "three_point_attempts_per_game": 2.0}  # 20 tries are too few
    r = _brief(spark, few, "C")
    assert _part(r["report"], "## Strong points") == "- A part in all of it: 8.0 points [E1], 3.0 rebounds [E2], 1.0 assists [E3]."
    assert "aren't in the data" in _part(r["report"], "## Watch") and "Too few games" in _part(r["report"], "## Lately")
    assert "finishes and rebounds" in r["report"] and "spacing from others" in r["report"]
    none = _brief(spark, {}, None)
    assert json.loads(none["packet"]) == [] and "[no data]" in none["report"] and "what the numbers show" in none["report"]
    for position, role in (("G", "off the ball"), ("F-C", "on the wing")):
        assert role in _brief(spark, few, position)["report"]


@pytest.mark.parametrize(
    ("question", "stats", "topic", "said"),
    [
        ("Is he a Scorer?", PLAIN, "role", "creates first: 16.0 points [E1], 6.0 assists [E3]."), ("a playmaker?", PLAIN | {"points_per_game": 21.0, "assists_per_game": 7.0}, "role", "scores and creates alike"), ("scorer", PLAIN | {"points_per_game": 18.0}, "role", "scores first"),
        ("Recent scorer", PLAIN, "recent", "too few games"), ("shot type?", PLAIN | SHOTS, "shots", "most from rim, 40.0% of tries [E6], most by layup, 30.0% of tries [E11]"), ("shot type?", PLAIN, "none", "don't answer"), ("dunk or three", PLAIN, "long_range", "makes 40.0% of long shots [E5]."),
        ("three", PLAIN | SHOTS, "long_range", "40.0% of long shots [E5], which are 40.0% of all [E9]."), ("Can he shoot", PLAIN | {"three_points_made_per_game": 0.4}, "long_range", "too few long shots"), (None, {}, "none", "don't answer"),
    ],
)
def test_questions_are_answered_from_the_facts(spark, question, stats, topic, said):
    kind = T.StructType([T.StructField(c, T.StringType()) for c in ("k", "player_name", "position", "season", "trend", "question")] + [T.StructField(c, T.DoubleType()) for c in STATS])
    r = briefs.answers(spark.createDataFrame([("a", "Pat", "G", "1998-99", None, question, *[stats.get(c) for c in STATS])], kind), "k").first()
    assert (r["topic"], r["question"]) == (topic, question) and said in r["answer"]


def test_every_brief_holds_its_checks(spark, sf_dir):
    rows = QUERIES["scouting_briefs"](spark, sf_dir)
    values = F.transform(F.from_json("packet", "array<struct<value: double>>"), lambda f: f["value"])
    names = F.regexp_replace("report", r"Pat \d+ in \d{4}-\d{2}", "")
    checks = text.report_checks(names, F.col("packet"), values, briefs.BRIEF_SECTIONS)
    got = rows.select("report", *[c.alias(n) for n, c in checks.items()]).collect()
    assert got and all(r["sections_ok"] and r["citations_ok"] and r["not_empty"] for r in got)
    assert {r["unsupported"] for r in got} == {""}


def _simulated(spark, **changed):
    base = {"k": 1, "season": "1998-99", "added": None, "removed": None, "validated": False, "net_rating": 3.0, "base_net_rating": 1.0, "wins_low": 40.0, "wins_high": 50.0, "is_supported": True, "distance_ratio": 0.5, "talent_percentile": 80.0} | changed
    kind = "k int, season string, added array<string>, removed array<string>, validated boolean, net_rating double, base_net_rating double, wins_low double, wins_high double, is_supported boolean, distance_ratio double, talent_percentile double"
    rows = spark.createDataFrame([tuple(base.values())], kind)
    changes = spark.createDataFrame([(1, t, 0.5, 0.5 + d, d) for t, d in (("a", 0.1), ("b", -0.3), ("c", 0.2), ("d", 0.0), ("e", 0.05), ("f", 0.01), ("g", 0.02))], "k int, trait string, baseline double, simulated double, change double")
    profiles = spark.createDataFrame([(1, "shooter", 0.9), (1, "stopper", 0.2), (1, "runner", 0.4)], "k int, profile string, score double")
    near = spark.createDataFrame([(1, "T1", "1990-91", 50, 82, 4.0, 0.7), (2, "T2", "1990-91", 50, 82, 4.0, 0.9)], "k int, team string, season string, wins int, games int, net_rating double, similarity double")
    rotation = spark.createDataFrame([(1, "Pat", 30.0, 20.0, 0.083), (1, "Sam", 10.0, 35.0, 0.146)], "k int, player string, observed double, minutes double, share double")
    made = briefs.simulation_packets(rows, "k", changes=changes, profiles=profiles, neighbours=near, rotation=rotation)
    return made, briefs.simulation_reports(made, "k").first()["report"]


@pytest.mark.parametrize(
    ("changed", "said", "estimates"),
    [
        ({}, "the net rating rises from +1.0 [Q1] to +3.0 [Q2], a difference of +2.0 [Q3]. In 80 of 100 cases that is 40 to 50 wins [Q4].", 4),
        ({"net_rating": -1.0}, "the net rating falls from +1.0", 4),
        ({"net_rating": 1.04}, "nothing changes that the model can tell", 4),
        ({"is_supported": False, "distance_ratio": 2.26}, "the roster lies 2.3 times as far as history reaches [S1]. Its talent is at percentile 80", 0),
        ({"is_supported": False, "distance_ratio": None, "talent_percentile": None}, "the roster lies farther than history reaches [S1].", 0),
        ({"added": ["Pat"], "removed": ["Kim", "Lee"]}, "After adding Pat and removing Kim, Lee: no change of wins is given", 0),
        ({"added": ["Pat"], "is_supported": False}, "[V1]. It also lies 0.5 times", 0),
        ({"added": ["Pat"], "validated": True}, "After adding Pat: the net rating rises", 4),
        ({"net_rating": None}, "for the model has none", 0),
    ],
)
def test_simulations_say_what_their_packets_allow(spark, changed, said, estimates):
    made, report = _simulated(spark, **changed)
    packet = json.loads(made.select(F.to_json("packet")).first()[0])
    assert said in report and len(packet["quality"]) == estimates
    assert [c["trait"] for c in packet["changes"]] == ["b", "c", "a", "e", "g", "f"] and [p["profile"] for p in packet["profiles"]] == ["shooter", "runner", "stopper"]
    assert "- b: from 50% to 20%, -30% [C1]." in report and "- T1, 1990-91: 50 won, 32 lost, net rating +4.0 [N1]." in report and "T2" not in report
    assert "- stopper, at 20% [P3].\n- runner, at 40% [P2]." in report
    assert ("- Pat: 30.0 minutes before, 20.0 here [R2]." in report) == ("Pat" in (changed.get("added") or []))
    ids = {x["id"] for part in ("quality", "changes", "profiles", "neighbours", "rotation") for x in packet[part]} | {"S1", "T1", "V1"}
    assert set(re.findall(r"\[([A-Z]\d+)\]", report)) <= ids
    again = made.withColumn("packet", F.from_json(F.to_json("packet"), briefs.SIMULATION))
    assert briefs.simulation_reports(again, "k").first()["report"] == report


def test_registered_simulations(spark, sf_dir):
    packets = QUERIES["simulation_packets"](spark, sf_dir).collect()
    assert packets and all(r["same"] for r in packets)
    reports = QUERIES["simulation_reports"](spark, sf_dir).collect()
    assert len(reports) == len(packets) and all(r["sections_ok"] for r in reports)
    assert {len(json.loads(r["json"])["quality"]) for r in packets} == {0, 4}


def test_presets_weigh_what_they_name():
    from tallyforge.operators.retrieval import preset_weights

    assert preset_weights({"x": {"b": 3.0}}, "x", ["a", "b"]) == [1.0, 3.0]
    with pytest.raises(ValueError, match="no preset"):
        preset_weights({"x": {}}, "y", ["a"])


def test_every_question_has_an_answer(spark, sf_dir):
    rows = QUERIES["question_answers"](spark, sf_dir).collect()
    assert len(rows) == QUERIES["scouting_briefs"](spark, sf_dir).count() and all(r["answer"] for r in rows)
    assert {r["topic"] for r in rows} == {"recent", "role", "shots", "long_range", "none"}
