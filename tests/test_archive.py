"""Sources, sinks, retrieval, rosters and the stream of partials on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import aggregate, evaluate, retrieval, roster
from tallyforge.sources import archive, schema
from tallyforge.streaming import incremental

HEADER = [c.split()[0] for c in schema.PLAYER_GAMES.replace("\n", " ").split(", ")]


def _csv(path, rows):
    lines = [",".join(HEADER)] + [",".join(str(r.get(c, "")) for c in HEADER) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def _game(**more):
    return {"firstName": "A", "lastName": "B", "personId": 1, "gameId": 10, "gameDate": "2024-10-01", "gameType": "Regular Season", "numMinutes": 30, "points": 20, "playerteamId": 1, "opponentteamId": 2} | more


def test_seasons_types_and_activity(spark, tmp_path):
    path = _csv(tmp_path / "games.csv", [
        _game(),
        _game(gameId=11, gameDate="2025-04-01", gameType="Playoffs", points=10),
        _game(gameId=12, gameDate="1946-11-01", gameType="In-Season Tournament", numMinutes=""),
        _game(gameId=13, numMinutes="", points=0),
        _game(personId="x", gameId=14),
    ])
    out = str(tmp_path / "archive")
    counts = {(r["season"], r["season_type"]): r["count"] for r in archive.build_games(spark, path, out, schema.PLAYER_GAMES).collect()}
    assert counts == {("2024-25", "regular"): 1, ("2024-25", "playoffs"): 1, ("1946-47", "regular"): 1}
    assert archive.read_seasons(spark, out, first="2000-01").count() == 1
    assert [r["game_id"] for r in archive.history(spark, out, 1).collect()][0] == 12
    # Only the partitions that are written again change.
    again = archive.normalise_games(archive.read_csv(spark, _csv(tmp_path / "more.csv", [_game(gameId=20), _game(gameId=21)]), schema.PLAYER_GAMES))
    archive.write_partitions(again, out)
    assert spark.read.parquet(out).count() == 4


def test_missing_columns_stop_the_job(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("personId\n1\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        archive.read_csv(spark, str(tmp_path / "bad.csv"), schema.PLAYER_GAMES)


def test_validation_finds_unknown_and_repeated_keys(spark):
    players = spark.createDataFrame([(1,), (2,)], "player_id long")
    seasons = spark.createDataFrame([(1, "2024-25")], "player_id long, season string")
    games = spark.createDataFrame([(1, 10)], "player_id long, game_id long")
    archive.validate(players, seasons, games)
    with pytest.raises(ValueError):
        archive.validate(players, seasons, games.unionByName(games))
    with pytest.raises(ValueError):
        archive.validate(players, seasons, spark.createDataFrame([(3, 10)], "player_id long, game_id long"))


def test_repair_needs_a_match_rate(spark):
    rows = spark.createDataFrame([(1, None), (2, "X")], "k int, team string")
    fixed = archive.repair_by_lookup(rows, spark.createDataFrame([(1, "Y")], "k int, team string"), ["k"], "team")
    assert sorted(r["team"] for r in fixed.collect()) == ["X", "Y"]
    with pytest.raises(ValueError):
        archive.repair_by_lookup(rows, spark.createDataFrame([(9, "Y")], "k int, team string"), ["k"], "team")


def test_stream_of_partials_gives_the_same_totals(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, float(i) if i % 4 else None) for i in range(40)], "k int, v double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.follow(source, ["k"], ["v"], "v", str(tmp_path / "parts"), str(tmp_path / "check")).awaitTermination()
    found = incremental.totals(spark, str(tmp_path / "parts"), ["k"], ["v"], "v")
    whole = aggregate.finish(aggregate.partials(rows, ["k"], ["v"], "v"), ["v"], "v")
    assert sorted(map(tuple, found.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_top_matches_in_blocks_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 17)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    found = retrieval.top_matches(rows, rows, "k", "v", 4).collect()
    assert {(r["query"], r["rank"], r["k"]) for r in found} == {(q, i + 1, int(k)) for q in range(60) for i, k in enumerate(np.argsort(-sims[q])[:4])}


def test_best_matches_with_filters_and_one_of_each_kind(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    v, kind = rng.normal(size=(50, 3)), rng.integers(0, 6, 50)
    rows = spark.createDataFrame([(i, v[i].tolist(), int(kind[i])) for i in range(50)] + [(99, None, 1)], "k long, v array<double>, kind int")
    sims = retrieval.angular_scores(v, v)
    np.fill_diagonal(sims, -1)
    near = lambda q, r: abs(q["kind"][:, None] - r["kind"][None, :]) <= 1
    score = lambda q, r: retrieval.angular_scores(q["v"], r["v"])
    ask = rows.filter("k % 10 = 0")
    got = {(r["query"], r["rank"]): r["k"] for r in retrieval.best_matches(ask, rows, "k", ["v", "kind"], score, 4, keep=near).collect()}
    kinds = {(r["query"], r["rank"]): r["k"] for r in retrieval.best_matches(ask, rows, "k", ["v"], score, 3, unique="kind").collect()}
    for q in range(0, 50, 10):
        allowed = [i for i in np.argsort(-sims[q]) if i != q and abs(kind[i] - kind[q]) <= 1][:4]
        assert [got[q, i + 1] for i in range(len(allowed))] == allowed
        best, seen = [], set()
        for i in np.argsort(-sims[q]):
            if i != q and kind[i] not in seen:
                seen.add(kind[i])
                best.append(i)
        assert [kinds[q, i + 1] for i in range(3)] == best[:3]
    counted = {(r["query"], r["score"]): r["n"] for r in retrieval.counted_scores(ask, rows, "k", ["v"], score, digits=1).collect()}
    assert sum(counted.values()) == 5 * 49 and counted[0, 0.5] == (np.round(np.delete(sims[0], 0), 1) == 0.5).sum()
    assert retrieval.best_matches(ask.limit(0), rows, "k", ["v"], score, 4).count() == 0


def water_fill(weights, total=240.0, cap=48.0):
    w = np.clip(np.nan_to_num(weights.astype(float)), 0, None)
    out, open_, left = np.zeros(len(w)), w > 0, float(total)
    while left > 1e-9 and open_.any():
        share = np.where(open_, left * w / w[open_].sum(), 0)
        full = open_ & (share >= cap)
        if not full.any():
            return np.where(open_, share, out)
        out[full] = cap
        left -= cap * full.sum()
        open_ &= ~full
    return out


def test_native_minutes_agree_with_water_filling(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(w)) for g in range(20) for i, w in enumerate(rng.exponential(size=rng.integers(1, 14)) * (rng.random() > 0.1))]
    df = spark.createDataFrame(rows, "g int, i int, w double")
    got = {(r["g"], r["i"]): r["minutes"] for r in roster.fit_minutes(df, "g", "w").collect()}
    for g in range(20):
        mine = [r for r in rows if r[0] == g]
        want = water_fill(np.array([r[2] for r in mine]))
        assert [got[g, r[1]] for r in mine] == pytest.approx(want.tolist(), abs=1e-6)


def test_ranking_quality_by_hand(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    r = evaluate.ranking_quality(rows, "s", "y").first()
    assert r["roc_auc"] == pytest.approx(3.5 / 4)
    assert r["average_precision"] == pytest.approx((1 * 1 + 1 * 2 / 3) / 2)


def test_latest_team_skips_blank_names(spark):
    g = spark.createDataFrame([(1, "A", "2024-01-01", 1), (1, " ", "2024-02-01", 2)], "player_id long, team string, game_date string, game_id long")
    assert archive.latest_teams(g.withColumn("game_date", F.to_date("game_date"))).first()["team"] == "A"
