"""Queries over styles: neighbours with all filters and blends, own history, pairs, frozen encoders. Vectors stand in for player seasons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyforge.functions.vectors import doubles
from tallyforge.operators import style
from tallyforge.plans.base import query, read
from tallyforge.plans.players import _rounded
from tallyforge.plans.search import ANG

ROWS = """WITH e AS (SELECT vec_id, vec_id % 97 AS player, vec_id % 7 AS season, 20 + vec_id % 15 AS age, CASE vec_id % 4 WHEN 0 THEN 'G-F' WHEN 1 THEN 'G' WHEN 2 THEN 'C' ELSE 'F' END AS position, CASE WHEN vec_id % 25 <> 7 THEN (vec_id % 11) / 2.0 END AS impact, vec_id % 2 = 0 AS covered, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT *, v[1:32] AS s, v[33:64] AS d, [greatest(z, 0.0) for z in v[1:16]] AS p FROM e)"""
INFO = [0.5 + i / 20 for i in range(16)]
SUM = "list_sum([{f}(z[1], z[2]) for z in list_zip(a.p, b.p)])"
ABS = "list_sum([CASE WHEN z[1] <= 0.01 {op} z[2] <= 0.01 THEN z[3] ELSE 0 END for z in list_zip(a.p, b.p, CAST(" + str(INFO) + " AS DOUBLE[]))])"


def _rows(spark, sf):
    k = F.col("vec_id")
    v = doubles(F.col("embedding"))
    return read(spark, sf, "embeddings").select(
        "vec_id", (k % 97).alias("player"), (k % 7).alias("season"), (20 + k % 15).alias("age"), F.when(k % 4 == 0, "G-F").when(k % 4 == 1, "G").when(k % 4 == 2, "C").otherwise("F").alias("position"), F.when(k % 25 != 7, (k % 11) / 2.0).alias("impact"), (k % 2 == 0).alias("covered"),
        v.alias("v"), F.slice(v, 1, 32).alias("s"), F.slice(v, 33, 32).alias("d"), F.transform(F.slice(v, 1, 16), lambda z: F.greatest(z, F.lit(0.0))).alias("p"),
    )


@query("style_neighbors", ROWS + f""", k AS (SELECT a.vec_id AS query, b.vec_id, b.player, {ANG.format(a='a.v', b='b.v')} AS base, 0.95 * coalesce({SUM.format(f='least')} / nullif({SUM.format(f='greatest')}, 0), 0) + 0.05 * coalesce({ABS.format(op='AND')} / nullif({ABS.format(op='OR')}, 0), 0) AS behaviour,
  CASE WHEN a.covered AND b.covered THEN 0.5 * ({ANG.format(a='a.s', b='b.s')}) + 0.5 * ({ANG.format(a='a.d', b='b.d')}) ELSE {ANG.format(a='a.s', b='b.s')} END AS learned
  FROM x a JOIN x b ON a.vec_id % 50 = 0 AND a.player <> b.player AND b.season >= 1 AND b.season <= 5 AND b.age >= 22 AND b.age <= 33 AND (contains(a.position, 'G') AND contains(b.position, 'G') OR contains(a.position, 'F') AND contains(b.position, 'F') OR contains(a.position, 'C') AND contains(b.position, 'C')) AND abs(b.impact - a.impact) <= 2),
t AS (SELECT *, 0.4 * (0.7 * base + 0.3 * behaviour) + 0.6 * learned AS score FROM k), u AS (SELECT *, row_number() OVER (PARTITION BY query, player ORDER BY score DESC, vec_id) AS o FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM u WHERE o = 1)
SELECT query, vec_id, player, round(score, 8) AS score, rank FROM r WHERE rank <= 10""")
def style_neighbors(spark, sf):
    rows = _rows(spark, sf)
    out = style.style_neighbors(rows.filter("vec_id % 50 = 0"), rows, n=10, presence="p", presence_weight=0.3, information=INFO, stable="s", detailed="d", learned_weight=0.6, seasons=(1, 5), ages=(22, 33), position_aware=True, impact="impact", tolerance=2.0)
    return out.select("query", "vec_id", "player", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("absence_weights", ROWS + ", w AS (SELECT " + ", ".join(f"{w} * (1 - avg(CASE WHEN p[{i + 1}] <= 0.01 THEN 1.0 ELSE 0 END)) AS f{i}" for i, w in enumerate(INFO[:4])) + " FROM x) SELECT feature, round(information, 9) AS information FROM (UNPIVOT w ON f0, f1, f2, f3 INTO NAME feature VALUE information)")
def absence_weights(spark, sf):
    rows = _rows(spark, sf).select(*[F.get("p", i).alias(f"f{i}") for i in range(4)])
    return _rounded(style.absence_information(rows, {f"f{i}": INFO[i] for i in range(4)}), ["feature"])


@query("self_history", ROWS + f""", h AS (SELECT a.player, a.season AS query_season, b.season, {ANG.format(a='a.v', b='b.v')} AS score, row_number() OVER (PARTITION BY a.player, a.season ORDER BY b.season DESC) AS place FROM (SELECT * FROM x WHERE vec_id < 679) a JOIN (SELECT * FROM x WHERE vec_id < 679) b ON a.player = b.player AND b.season < a.season WHERE a.vec_id % 50 = 0)
SELECT player, query_season, season, round(score, 8) AS score, place FROM h WHERE place <= 3""")
def self_history(spark, sf):
    rows = _rows(spark, sf).filter("vec_id < 679")  # player and season are a key of these
    out = style.self_history(rows.filter("vec_id % 50 = 0"), rows)
    return out.select("player", "query_season", "season", F.round("score", 8).alias("score"), F.col("place").cast("long").alias("place"))


@query("closest_pairs", ROWS + f""", h AS (SELECT a.player AS a, b.player AS b, a.season AS season_a, b.season AS season_b, {ANG.format(a='a.v', b='b.v')} AS score FROM (SELECT * FROM x WHERE vec_id < 679) a JOIN (SELECT * FROM x WHERE vec_id < 679) b ON b.player = a.player + 1), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, season_a, season_b) AS k FROM h)
SELECT a, b, season_a, season_b, round(score, 8) AS score FROM r WHERE k = 1""")
def closest_pairs(spark, sf):
    rows = _rows(spark, sf).filter("vec_id < 679")
    pairs = rows.select(F.col("player").alias("a"), (F.col("player") + 1).alias("b")).distinct()
    return _rounded(style.closest_pairs(pairs, rows, "a", "b"), ["a", "b"], 8)


MODEL = {f"f{i}": (0.05 * i, 0.02 * i, [0.3, 0.0, 0.2, 0.4][i], 1.0 + i / 4) for i in range(4)}
FEATURES = ROWS + ", f AS (SELECT vec_id, " + ", ".join(f"CASE WHEN vec_id % 9 <> {i} THEN v[{i + 1}] END AS f{i}" for i in range(4)) + " FROM x)"


def _features(spark, sf):
    return _rows(spark, sf).select("vec_id", *[F.when(F.col("vec_id") % 9 != i, F.get("v", i)).alias(f"f{i}") for i in range(4)])


@query("pair_features", FEATURES + ", g AS (" + " UNION ALL ".join(f"SELECT a.vec_id AS a, b.vec_id AS b, 'f{i}' AS feature, a.f{i} AS reference, b.f{i} AS match, coalesce(a.f{i}, {m[0]}) AS x, coalesce(b.f{i}, {m[0]}) AS y, {m[2] or 1.0} AS sc, {m[3]} AS w, {INFO[i]} AS info FROM f a JOIN f b ON b.vec_id = a.vec_id + 1" for i, m in enumerate(MODEL.values())) + """), h AS (SELECT *, abs(x - y) / sc * w AS gap FROM g)
SELECT a, b, feature, round(reference, 8) AS reference, round(match, 8) AS match, round(gap, 8) AS gap, round(greatest(0, least(x, y) / sc * w) / (1 + gap), 8) AS shared_tendency, CASE WHEN x <= 0.01 AND y <= 0.01 THEN CAST(info AS DOUBLE) ELSE 0 END AS shared_absence, row_number() OVER (PARTITION BY a, b ORDER BY greatest(0, least(x, y) / sc * w) / (1 + gap) DESC, gap, feature) AS place FROM h""")
def pair_features(spark, sf):
    rows = _features(spark, sf)
    pairs = rows.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    info = spark.createDataFrame([(f"f{i}", INFO[i]) for i in range(4)], "feature string, information double")
    out = style.strongest(style.pair_features(pairs, rows, "a", "b", "vec_id", MODEL, info), ["a", "b"], [F.desc("shared_tendency"), F.col("gap"), F.col("feature")])
    return _rounded(out.withColumn("place", F.col("place").cast("long")), ["a", "b", "feature"], 8)


@query("exclusive_drivers", ROWS + ", r AS (SELECT vec_id // 4 AS pair, vec_id, v[1] AS alike, v[2] AS apart FROM x), s AS (SELECT *, greatest(0, alike) / nullif(sum(greatest(0, alike)) OVER (PARTITION BY pair), 0) AS sa, greatest(0, apart) / nullif(sum(greatest(0, apart)) OVER (PARTITION BY pair), 0) AS sd FROM r), t AS (SELECT pair, vec_id, CASE WHEN alike > 0 AND coalesce(sa, 0) >= coalesce(sd, 0) THEN 'alike' WHEN apart > 0 THEN 'apart' END AS driver FROM s) SELECT * FROM t WHERE driver IS NOT NULL")
def exclusive_drivers(spark, sf):
    rows = _rows(spark, sf).select(F.floor(F.col("vec_id") / 4).alias("pair"), "vec_id", F.get("v", 0).alias("alike"), F.get("v", 1).alias("apart"))
    return style.exclusive_drivers(rows, ["pair"]).select("pair", "vec_id", "driver")


MATRIX = [[0.4, -0.2, 0.7, 0.1], [-0.5, 0.3, 0.2, 0.6]]
BIAS = [0.05, -0.1]
_CLEAN = [f"(coalesce(f{i}, {m[0]}) - {m[1]}) / {m[2] or 1.0} * {m[3]}" for i, m in enumerate(MODEL.values())]


@query("linear_encoder", FEATURES + ", t AS (SELECT vec_id, " + ", ".join(f"tanh({' + '.join(f'{w} * ({c})' for w, c in zip(row, _CLEAN, strict=True))} + {b}) AS t{i}" for i, (row, b) in enumerate(zip(MATRIX, BIAS, strict=True))) + " FROM f) SELECT vec_id, round(t0 / sqrt(t0 * t0 + t1 * t1), 8) AS v0, round(t1 / sqrt(t0 * t0 + t1 * t1), 8) AS v1 FROM t")
def linear_encoder(spark, sf):
    out = style.linear_encoder(_features(spark, sf), ["vec_id"], MODEL, MATRIX, BIAS, "tanh")
    return out.select("vec_id", F.round(F.get("v", 0), 8).alias("v0"), F.round(F.get("v", 1), 8).alias("v1"))


def network() -> dict:
    """A small frozen network of fixed numbers."""
    rng = np.random.default_rng(11)
    sizes = [4, 8, 6, 3]
    layers = [(rng.normal(size=(b, a)), rng.normal(size=b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    return {"features": list(MODEL), "median": [m[0] for m in MODEL.values()], "mean": [m[1] for m in MODEL.values()], "scale": [m[2] for m in MODEL.values()], "layers": layers}


@query("network_encoder")
def network_encoder(spark, sf):
    return style.mlp_encoder(_features(spark, sf), ["vec_id"], network()).select("vec_id", *[F.get("v", i).alias(f"v{i}") for i in range(3)])


@query("pair_attribution")
def pair_attribution(spark, sf):
    rows = _features(spark, sf)
    pairs = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return style.pair_attribution(pairs, rows, "a", "b", "vec_id", network())
