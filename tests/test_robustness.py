"""Cohorts, resamples, ablations, checked joins, the cell index and rotations against the same by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import index, joins, retrieval, robustness, roster
from tallyforge.plans.queries import QUERIES


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "k long, v array<double>")


def test_cohorts_are_cut_to_shared_keys_and_ranked_among_them(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    a = {k: rng.normal(size=4) for k in range(40) if k % 5}
    b = {k: rng.normal(size=4) + a.get(k, 0) for k in range(60) if k % 3}
    b[7] = b[8]  # equal vectors: the smaller key is first
    first, second = ([(k, v.tolist()) for k, v in d.items()] for d in (a, b))
    got = {r["k"]: r for r in robustness.cohort_ranks(_vectors(spark, [*first, (4, [0.0] * 4), (41, None)]).filter("k <> 4 or v[0] <> 0"), _vectors(spark, second), "k", "v").collect()}
    shared = sorted(set(a) & set(b))
    assert sorted(got) == shared
    u = lambda x: x / np.linalg.norm(x)
    for k in shared:
        s = {c: float(u(a[k]) @ u(b[c])) for c in shared}
        others = [c for c in shared if c != k]
        assert got[k]["own"] == pytest.approx(s[k]) and got[k]["best_other"] == pytest.approx(max(s[c] for c in others)) and got[k]["candidates"] == len(shared)
        if k not in (7, 8):
            assert got[k]["rank"] == 1 + sum(s[c] > s[k] for c in others)
    quality = robustness.cohort_quality(robustness.cohort_ranks(_vectors(spark, first), _vectors(spark, second), "k", "v")).first()
    assert quality["eligible_queries"] == len(shared) and quality["median_rank"] == np.median([r["rank"] for r in got.values()])
    assert quality["mean_self_margin"] == pytest.approx(np.mean([r["own"] - r["best_other"] for r in got.values()]))


def test_a_repeated_key_stops_the_join_that_forbids_it(spark):
    many = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 3, "c"), (None, 3, "d")], "x long, y long, z string")
    one = spark.createDataFrame([(1, 2, 5), (1, 4, 6), (None, 3, 7), (None, 3, 8)], "x long, y long, w long")
    assert {tuple(r) for r in joins.checked_join(many, one, ["x", "y"]).select("z", "w").collect()} == {("a", 5), ("b", 5)}
    assert joins.checked_join(many, one, ["x", "y"], how="left").count() == 4
    with pytest.raises(Exception, match="repeat on the left of a 1:1 join"):
        joins.checked_join(many, one, ["x", "y"], validate="1:1").select("z").collect()
    twice = one.unionByName(one.filter("y = 4"))  # a key that nothing meets still has to be unique
    with pytest.raises(Exception, match="repeat on the right of a m:1 join"):
        joins.checked_join(many, twice, ["x", "y"]).select("z").collect()
    with pytest.raises(ValueError, match="validate"):
        joins.checked_join(many, one, ["x"], validate="n:m")


def test_variants_leave_groups_out(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "k long, a double, b double, c double")
    got = {r["variant"]: (r["a"], r["b"], r["c"]) for r in robustness.variants(rows, {"x": ["a", "b"], "y": ["c"]}, ["a", "b", "c"]).collect()}
    assert got == {"full": (1, 2, 3), "without_x": (None, None, 3), "only_x": (1, 2, None), "without_y": (1, 2, None), "only_y": (None, None, 3)}


def test_metadata_that_an_encoder_reads_is_found(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 6.0)], "k long, a double, team double")
    clean = lambda df: df.select("k", F.array("a").alias("v"))
    leaks = lambda df: df.select("k", F.array(F.col("a"), F.col("team") / 10).alias("v"))
    assert tuple(robustness.largest_change(rows, clean, ["k"], {"team": -1.0}).first()) == (2, 0.0)
    assert tuple(robustness.largest_change(rows, leaks, ["k"], {"team": -1.0}).first()) == (2, pytest.approx(0.7))


def test_exposure_and_rank_changes(spark):
    ranks = spark.createDataFrame([("full", 1, 1), ("full", 2, 4), ("less", 1, 3), ("less", 2, 2)], "variant string, k long, rank long")
    got = {r["variant"]: r for r in robustness.rank_changes(ranks, "k").collect()}
    assert got["less"]["mean_rank_change"] == 0 and got["less"]["falls"] == got["less"]["rises"] == 0.5 and got["full"]["mean_reciprocal_rank"] == pytest.approx(0.625)
    seen = robustness.exposed(ranks, spark.createDataFrame([(1,), (1,)], "k long"), "k").collect()
    assert len(seen) == 4 and all(r["seen"] == (r["k"] == 1) for r in seen)


def test_resamples_draw_about_as_many_and_not_the_same(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    got = robustness.resampled(rows, "k", 20).groupBy("resample").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("weight")).alias("s"), F.count("*").alias("rows")).collect()
    assert len(got) == 20 and all(abs(r["n"] - 3000) < 5 * 3000**0.5 for r in got)
    assert all(abs(r["rows"] / 3000 - (1 - np.exp(-1))) < 0.05 and abs(r["s"] / 3000 - 2) < 0.25 for r in got)  # a Poisson count of mean 1
    assert len({r["rows"] for r in got}) > 10
    again = robustness.resampled(rows, "k", 20)
    assert again.exceptAll(robustness.resampled(rows, "k", 20)).isEmpty()


def test_stability_by_hand(spark):
    rng = np.random.default_rng(5)
    base = {k: rng.normal(size=3) for k in range(30)}
    samples = {(r, k): base[k] + 0.4 * rng.normal(size=3) for r in (1, 2) for k in range(30) if (k + r) % 6}
    rows = spark.createDataFrame([(r, k, v.tolist()) for (r, k), v in samples.items()], "resample int, k long, v array<double>")
    got = {(r["resample"], r["k"]): r for r in robustness.stability(_vectors(spark, [(k, v.tolist()) for k, v in base.items()]), rows, "k", "v", ask=F.col("k") % 2 == 0, n=5).collect()}
    assert set(got) == set(samples)
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    for (r, k), row in got.items():
        assert row["cosine"] == pytest.approx(cos(samples[r, k], base[k]))
        if k % 2:
            assert row["jaccard"] is None
            continue
        keys = [c for s, c in samples if s == r and c != k]
        a = set(sorted(keys, key=lambda c: -cos(base[k], base[c]))[:5])
        b = set(sorted(keys, key=lambda c: -cos(samples[r, k], samples[r, c]))[:5])
        assert row["jaccard"] == pytest.approx(len(a & b) / len(a | b))


def test_a_query_moves_once_for_a_group_of_cells(spark, monkeypatch):
    """It moved once for each cell that it looks into."""
    monkeypatch.setattr(index, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(4)
    e = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "k long, v array<double>")
    cells = index.fit(e, "k", "v", cells=30)
    assert cells.probes > 6
    sent, score = spark.sparkContext.accumulator(0), index.leaders

    def counted(measure, n, drop):
        sent.add(measure.size[0])
        return score(measure, n, drop)

    monkeypatch.setattr(index, "leaders", counted)
    found = {(r["query"], r["k"]) for r in index.near_matches(e, e, "k", "v", 5, cells).collect()}
    x = np.array([r["v"] for r in e.orderBy("k").collect()])
    own, looks = cells.nearest(x, 1)[:, 0], cells.nearest(x, cells.probes)
    sims = index.units(x) @ index.units(x).T
    np.fill_diagonal(sims, -np.inf)
    want = {(i, int(j)) for i in range(600) for j in np.argsort(-np.where(np.isin(own, looks[i]), sims[i], -np.inf), kind="stable")[:5]}
    assert found == want
    assert sent.value < 600 * cells.probes / 2


def test_cells_find_nine_in_ten_and_score_exactly(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_ROWS", 16)  # cells in parts
    r = QUERIES["ann_recall"](spark, sf_dir).first()
    assert r["queries"] == 10 and r["recall"] >= 0.9
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).tolist(), i // 12 % 3) for i in range(1500)] + [(5000, None, 1)]
    e = spark.createDataFrame(rows, "k long, v array<double>, label int")
    cells = index.fit(e, "k", "v", sample_rows=600)
    assert cells.probes < len(cells.centroids) / 2  # clusters: a query needn't look everywhere
    q = e.filter("k % 50 = 0 and v is not null")
    found, exact = index.near_matches(q, e, "k", "v", 10, cells, carry=["label"]), retrieval.top_matches(q, e, "k", "v", 10)
    assert index.recall_of(found, exact, "k").first()["recall"] >= 0.9
    both = found.join(exact.select("query", "k", F.col("cosine").alias("c")), ["query", "k"]).collect()
    assert all(x["cosine"] == pytest.approx(x["c"]) and x["label"] == x["k"] // 12 % 3 for x in both)
    pairs = index.near_pairs(e, "k", "v", "label", 30, cells).collect()
    want = retrieval.top_pairs(e.filter("v is not null"), "k", "v", "label", 30).collect()
    assert len({(x["a"], x["b"]) for x in pairs} & {(x["a"], x["b"]) for x in want}) >= 27
    assert index.near_matches(q.limit(0), e.limit(0), "k", "v", 10, index.fit(e.limit(0), "k", "v")).count() == 0


def _allocated(players, total=240.0):
    """The rules of a rotation, step by step; players: key, positions, quality, minutes, base, forced."""
    players = sorted(players, key=lambda p: p[0])
    minutes = {p[0]: p[4] or 0.0 for p in players}
    open_ = max(0.0, total - sum(minutes.values()))
    audit = {}
    for key, at, q, mpg, base, forced in sorted((p for p in players if p[4] is None), key=lambda p: -p[2]):
        want = min(42.0, max(0.0, mpg))
        used = min(want, open_)
        minutes[key], open_, left = used, open_ - used, want - used
        first, lost = at.split("-")[0], []
        met = [p for p in players if p[0] != key and minutes[p[0]] > 0 and first in p[1].split("-")]
        for o in sorted((p for p in met if forced or p[2] < q), key=lambda p: (set(p[1].split("-")) != {first}, minutes[p[0]] * (0.5 + p[2]))):
            cut = min(left, minutes[o[0]] * (1.0 if forced else min(1.0, (q - o[2]) / 0.2)))
            minutes[o[0]] -= cut
            minutes[key] += cut
            left -= cut
            if cut > 1e-9:
                lost.append((o[0], cut))
            if left <= 1e-9:
                break
        blocked = sorted((p[2], minutes[p[0]], p[0]) for p in met if p[2] >= q and minutes[p[0]] > 0)
        audit[key] = (want, used, lost, blocked)
    gap = total - sum(minutes.values())
    room = {p[0]: min(42.0, p[3]) if p[4] is None else 42.0 for p in players}
    able = {p[0]: p[3] * (0.5 + p[2]) for p in players if p[3] * (0.5 + p[2]) > 0}
    while gap > 1e-6 and able:
        whole, given = sum(able.values()), 0.0
        for k, w in able.items():
            more = min(max(0.0, room[k] - minutes[k]), gap * w / whole)
            minutes[k] += more
            given += more
        gap -= given
        able = {k: w for k, w in able.items() if minutes[k] < room[k] - 1e-9}
        if given <= 1e-9:
            break
    return minutes, audit


def test_rotations_step_by_step(spark):
    rng, rows = random.Random(11), []
    for team in range(60):
        n = rng.randrange(1, 14)
        for k in range(n):
            new = rng.random() < 0.35
            rows.append((f"t{team}", k, rng.choice(["G", "F", "C", "G-F", "F-C", "F-G"]), rng.choice([0.2, 0.5, 0.55, rng.random()]), float(rng.choice([0, 5, 20, 34, 47])), None if new else float(rng.choice([0, 6, 18, 30, 40])), rng.random() < 0.3))
    df = spark.createDataFrame(rows, "roster string, k long, position string, quality double, minutes_per_game double, base double, forced boolean")
    got = {r["roster"]: r for r in roster.allocate(df, "roster", "k").collect()}
    for team in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == team]
        minutes, audit = _allocated([(k, p, q, m, b, f) for k, p, q, m, b, f in mine])
        after = {p["player"]: p["after"] for p in got[team]["players"]}
        assert after == pytest.approx(minutes, abs=1e-5), team
        assert [p["after"] for p in got[team]["players"]] == sorted(after.values(), reverse=True)
        seen = {a["player"]: a for a in got[team]["audit"]}
        assert set(seen) == set(audit)
        for k, (want, used, lost, blocked) in audit.items():
            a = seen[k]
            assert (a["requested"], a["open_used"]) == pytest.approx((want, used))
            assert [d["player"] for d in a["displaced"]] == [x for x, _ in lost] and [d["minutes"] for d in a["displaced"]] == pytest.approx([x for _, x in lost])
            assert [b["player"] for b in a["blocked_by"]] == [x for _, _, x in blocked]
            assert a["assigned"] == pytest.approx(minutes[k], abs=1e-5) and a["unfilled"] == pytest.approx(max(0, want - minutes[k]), abs=1e-5)
    odd = spark.createDataFrame([("a", 1, None, None, None, None, None), ("a", 2, "G", 0.4, 30.0, 20.0, None)], df.schema)
    assert {p["player"]: p["after"] for p in roster.allocate(odd, "roster", "k").first()["players"]} == {1: 0.0, 2: 42.0}
    assert roster.allocate(df.limit(0), "roster", "k").count() == 0
    with pytest.raises(Exception, match="more than 2 players"):
        roster.allocate(df, "roster", "k", most=2).collect()


def test_registered_rotations_hold_their_rules(spark, sf_dir):
    rows = QUERIES["allocation"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert all(-1e-9 <= r["after"] <= 42 + 1e-6 for r in rows)
    audit = QUERIES["allocation_audit"](spark, sf_dir).collect()
    assert audit and all(a["assigned"] <= a["requested"] + 1e-6 for a in audit)
    found = QUERIES["bootstrap_stability"](spark, sf_dir).collect()
    assert found and all(-1 <= r["p10_cosine"] <= r["mean_cosine"] + 0.5 <= 1.5 and r["compared"] > 0 for r in found)


def test_rotations_of_many_rosters_end(spark, tmp_path):
    """eight thousand rosters; nested lambdas of the JVM took minutes for some hundreds."""
    import time

    rows = spark.range(120_000).selectExpr("id DIV 15 AS roster", "id AS k", "element_at(array('G', 'G-F', 'F', 'F-C', 'C'), CAST(id % 5 AS INT) + 1) AS position", "id % 100 / 100.0D AS quality", "CAST(id % 37 AS DOUBLE) AS minutes_per_game", "CASE WHEN id % 3 > 0 THEN 20.0D END AS base", "id % 21 = 0 AS forced")
    start = time.perf_counter()
    assert roster.allocate(rows, "roster", "k").selectExpr("sum(size(players)) AS n", "sum(size(audit)) AS a").first().asDict() == {"n": 120_000, "a": 40_000}
    assert time.perf_counter() - start < 60


def test_quality_is_of_every_shared_key(spark, sf_dir):
    """F8: means, recall and the median rank were those of keys divisible by 50."""
    ids = [r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    assert QUERIES["cohort_quality"](spark, sf_dir).first()["eligible_queries"] == sum(i % 7 != 3 and i % 9 != 4 for i in ids)


def test_resamples_are_added_up_without_repeating_rows(spark):
    """each order was a row for each resample that drew it before its customer's sums were made."""
    rows = spark.range(900, numPartitions=3).select((F.col("id") % 37).alias("k"), F.col("id").alias("o"), (F.col("id") % 11 * 1.5).alias("x"), F.sqrt("id").alias("y"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)  # a group goes over several batches
    try:
        made = robustness.resampled_means(rows, "k", "o", ["x", "y"], 6)
        assert "Generate explode" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    mean = lambda c: F.sum(F.col(c) * F.col("weight")) / F.sum("weight")
    want = {(r["k"], r["resample"]): (r["x"], r["y"]) for r in robustness.resampled(rows, "o", 6).groupBy("k", "resample").agg(mean("x").alias("x"), mean("y").alias("y")).collect()}
    found = {(r["k"], d["resample"]): (d["x"], d["y"]) for r in got for d in r["draws"]}
    assert set(found) == set(want) and all(found[i] == pytest.approx(want[i]) for i in want)
    base = {r["k"]: (r["n"], r["x"], r["y"]) for r in rows.groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).collect()}
    assert len(got) == 37 and all((r["attempts"], r["x"], r["y"]) == pytest.approx(base[r["k"]]) for r in got)


def test_neighbours_by_leaves_are_those_of_all_pairs(spark, monkeypatch):
    """neighbours of a few queries, in each resample, were looked for among all rows, block by block."""
    from tallyforge.operators import space

    monkeypatch.setattr(space, "LEAF", 8)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2, 300, 3))
    v[:, 40:90] = v[:, 40:41]
    rows = spark.createDataFrame([(r, k, x.tolist()) for r in (0, 1) for k, x in enumerate(v[r])], "r int, k long, v array<double>")
    for ask in ("k % 10 = 0", "true"):
        got, want = (f(rows.filter(ask), rows, "k", "v", 5, by=["r"]).select("r", "query", "k", "rank").collect() for f in (space.nearest_by_cosine, retrieval.top_matches))
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
