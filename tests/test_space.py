"""Searches of all rows against all rows, in parts and leaves, against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import retrieval, space
from tallyforge.plans.queries import QUERIES


def test_presets_ask_for_every_customer(spark, sf_dir):
    """only customers whose key is divisible by 50 were asked for."""
    found = QUERIES["preset_similarity"](spark, sf_dir)
    want = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert [r["n"] for r in found.groupBy("preset").agg(F.countDistinct("query").alias("n")).collect()] == [want, want]


def test_closest_of_all_are_those_of_all_pairs(spark, monkeypatch):
    """Many equal rows, rows that are as close, rows on a line, and parts and leaves of a few rows."""
    monkeypatch.setattr(space, "LEAF", 8)
    monkeypatch.setattr(space, "PART_BYTES", 8 * 5 * 150)
    rng = np.random.default_rng(3)
    v = np.round(rng.random((500, 3)), 1)
    v[:120] = v[0]
    v[120:260, :2] = 0.25
    v[499] = [9.0, 9.0, 9.0]  # so far from all that its scores are 0
    rows = spark.createDataFrame([(int(i * 7 % 1009), x.tolist()) for i, x in enumerate(v)] + [(2000, None)], "k long, v array<double>").repartition(5)
    for weights in ([1.0, 1.0, 1.0], [1.5, 3.0, 0.5]):
        got, want = space.closest_of_all(rows, "k", "v", weights, 4), retrieval.closest(rows, rows, "k", "v", weights, 4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4 * 500


def test_ranks_are_counted_as_by_all_pairs(monkeypatch):
    """Leaves of few rows, equal vectors, vectors of two directions only, and the vectors' own last digits."""
    monkeypatch.setattr(space, "COUNTED_LEAF", 20)
    monkeypatch.setattr(space, "FAN", 3)
    monkeypatch.setattr(space, "ASKED", 150)
    monkeypatch.setattr(space, "TILE", 7)
    rng = np.random.default_rng(8)
    for dim in (1, 2, 5):
        q, g = (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, 5)) for n in (400, 700))
        g[100:250] = g[100]
        q, g = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, g))
        ids = rng.permutation(1000)[:700]
        ks = ids[:400]
        s = np.round(retrieval.scores(q, g), 12)
        own = s[np.arange(400), np.arange(400)]
        want = ((s > own[:, None]) & (ids != ks[:, None]) | (s == own[:, None]) & (ids < ks[:, None])).sum(axis=1)
        assert (space.counted_within(q, own, ks, g, ids, 12) == want).all()


def test_ablation_asks_for_every_customer_in_few_copies(spark, sf_dir, monkeypatch):
    """only customers divisible by 50 were asked for, and each was a row for each 16384 others."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    both = orders.groupBy("o_custkey").agg(F.countDistinct(F.month("o_orderdate") <= 6).alias("n")).filter("n = 2").count()
    assert {r["variant"]: r["queries"] for r in QUERIES["group_ablation"](spark, sf_dir).collect()}["full"] == both
    monkeypatch.setattr(space, "TASKS", 1)
    rows = spark.range(40_000, numPartitions=1).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    pairs, _ = space.packed_pairs(rows, rows, "k", "v")
    made = pairs.applyInArrow(lambda t: t.select(["_side"]).append_column("n", [[len(x) // 32 for x in t.column("_rows").to_pylist()]]), "_side int, n long").groupBy("_side").sum("n").collect()
    assert sorted(map(tuple, made)) == [(0, 40_000), (1, 40_000)]
