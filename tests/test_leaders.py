"""Searches that estimate scores by tiles against plain sorting."""

from __future__ import annotations

import time

import numpy as np

from tallyforge.operators.retrieval import Closeness, Cosines, leaders, scores, units, weighted_closeness


def _sorted(sims, n, drop):
    sims = np.where(drop, -np.inf, sims)
    at = np.argsort(-sims, axis=1, kind="stable")[:, :n]
    return [(i, int(j), sims[i, j]) for i, line in enumerate(at) for j in line if np.isfinite(sims[i, j])]


def test_leaders_as_sorted(monkeypatch):
    """equal scores and order, with copies, zero vectors, near ties, few rows and pairs that do not count."""
    rng = np.random.default_rng(3)
    for rows, dims, n in ((9001, 6, 10), (700, 64, 15), (7, 3, 10), (5000, 1, 3), (4500, 2, 5)):
        b = rng.normal(size=(rows, dims))
        b[rows // 2 :] = b[: rows - rows // 2]  # every row twice
        b[5 % rows] = 0
        b[3 % rows] = b[2 % rows] * (1 + 1e-12)
        b = b.round(1) if dims == 2 else b
        a = b[:: max(1, rows // 600)]
        keys, ids = np.arange(rows)[:: max(1, rows // 600)], np.arange(rows)
        for drop in (lambda i, j: keys[i] == ids[j], lambda i, j: keys[i] % 5 == ids[j] % 5):  # noqa: B023
            dense = drop(np.arange(len(a))[:, None], np.arange(rows)[None, :])
            assert list(zip(*map(list, leaders(Cosines(a, b), n, drop)), strict=True)) == _sorted(scores(units(a), units(b)), n, dense)
            p, q = np.abs(a).clip(0, 1), np.abs(b).clip(0, 1)
            w = [1.0, 2.0, 0.5, 1, 1, 3][:dims]
            if dims <= 6:
                assert list(zip(*map(list, leaders(Closeness(p, q, w, 9), n, drop)), strict=True)) == _sorted(weighted_closeness(p, q, w).round(9), n, dense)
    assert all(len(x) == 0 for x in leaders(Cosines(np.zeros((0, 0)), b), 3, drop))


def test_leaders_cost_little_more_than_a_product():
    """A pair took some 100 ns, most of it in 64 sweeps over the matrix of scores and a full sort."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2000, 64)), rng.normal(size=(16000, 64))
    start = time.perf_counter()
    leaders(Cosines(a, b), 10, lambda i, j: np.zeros(np.broadcast(i, j).shape, bool))
    assert (time.perf_counter() - start) / (len(a) * len(b)) < 60e-9


def test_an_encoder_works_out_its_features_once(spark):
    """the features stood in the plan some hundred times, within lambdas that run for each entry."""
    from tallyforge.operators import style

    rows = spark.createDataFrame([(1, 3.0, 4.0), (2, None, 0.0)], "k long, x double, y double")
    out = style.linear_encoder(rows, ["k"], {"x": (0.0, 0.0, 1.0, 1.0), "y": (0.0, 0.0, 1.0, 1.0)}, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("coalesce") == 2
    assert np.allclose(out.orderBy("k").first()["v"], np.array([3, 4, 7]) / np.sqrt(74))


def test_styles_are_scored_some_queries_at_a_time(spark, sf_dir, monkeypatch):
    """Scores of a whole pair of blocks stood in memory a dozen times."""
    from tallyforge.operators import style
    from tallyforge.plans.queries import QUERIES

    want = {tuple(r) for r in QUERIES["style_neighbors"](spark, sf_dir).collect()}
    most, plain = spark.sparkContext.accumulator(0), style._angular

    def angular(q, r):
        if len(q) > 3:
            most.add(1)
        return plain(q, r)

    monkeypatch.setattr(style, "TILE_QUERIES", 3)
    monkeypatch.setattr(style, "_angular", angular)
    assert {tuple(r) for r in QUERIES["style_neighbors"](spark, sf_dir).collect()} == want and want
    assert most.value == 0
