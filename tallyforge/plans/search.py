"""Queries over vectors, models, names and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import labels, names, text
from tallyforge.functions.vectors import doubles, joined
from tallyforge.operators import evaluate, models, retrieval, space, windows
from tallyforge.plans.base import query, read
from tallyforge.plans.profiles import CUSTOMERS, RANK, _customers
from tallyforge.sources.scratch import kept

#: Queries of searches: every row whose id is divisible by 50, against all rows.
ASK = "vec_id % 50 = 0"
EMB = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
ANG = "1 - acos(greatest(-1, least(1, list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))))) / pi()"
SCORED = EMB + f", s AS (SELECT q.vec_id AS query, q.label AS ql, e.vec_id, e.label, {ANG.format(a='q.v', b='e.v')} AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)"
_RANK = "row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)"
_ROUND = "SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM"


def _embeddings(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("v"))


def _found(df):
    return df.select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def _angular(q, r):
    return retrieval.angular_scores(q["v"], r["v"])


@query("angular_topk", SCORED + f" {_ROUND} (SELECT *, {_RANK} AS rank FROM s) WHERE rank <= 20")
def angular_topk(spark, sf):
    e = _embeddings(spark, sf)
    return _found(retrieval.best_matches(e.filter(ASK), e, "vec_id", ["v"], _angular, 20))


@query("angular_topk_unique", SCORED + f", u AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS k FROM s) {_ROUND} (SELECT *, {_RANK} AS rank FROM u WHERE k = 1) WHERE rank <= 8")
def angular_topk_unique(spark, sf):
    e = _embeddings(spark, sf)
    return _found(retrieval.best_matches(e.filter(ASK), e, "vec_id", ["v"], _angular, 8, unique="label"))


@query("band_filtered_topk", SCORED + f" {_ROUND} (SELECT *, {_RANK} AS rank FROM s WHERE abs(label - ql) <= 2) WHERE rank <= 15")
def band_filtered_topk(spark, sf):
    e = _embeddings(spark, sf)
    near = lambda q, r: abs(q["label"][:, None] - r["label"][None, :]) <= 2
    return _found(retrieval.best_matches(e.filter(ASK), e, "vec_id", ["v", "label"], _angular, 15, keep=near))


@query("similarity_tiers", SCORED + """, g AS (SELECT query, round(score, 4) AS score FROM s) SELECT query, CASE WHEN score >= 0.95 THEN 'elite' WHEN score >= 0.9 THEN 'very strong' WHEN score >= 0.85 THEN 'strong' WHEN score >= 0.8 THEN 'clear' WHEN score >= 0.7 THEN 'moderate' WHEN score >= 0.6 THEN 'loose' ELSE 'distant' END AS tier, count(*) AS n FROM g GROUP BY 1, 2""")
def similarity_tiers(spark, sf):
    e = _embeddings(spark, sf)
    return retrieval.counted_scores(e.filter(ASK), e, "vec_id", ["v"], _angular).groupBy("query", labels.tier(F.col("score")).alias("tier")).agg(F.sum("n").alias("n"))


@query("coverage_blend", EMB + f""", h AS (SELECT vec_id, v[1:32] AS a, v[33:64] AS b, vec_id % 3 <> 1 AS c FROM e),
s AS (SELECT q.vec_id AS query, h.vec_id, CASE WHEN q.c AND h.c THEN 0.5 * ({ANG.format(a='q.a', b='h.a')}) + 0.5 * ({ANG.format(a='q.b', b='h.b')}) ELSE {ANG.format(a='q.a', b='h.a')} END AS score FROM h q JOIN h ON q.vec_id <> h.vec_id WHERE q.vec_id % 50 = 0) {_ROUND} (SELECT *, {_RANK} AS rank FROM s) WHERE rank <= 20""")
def coverage_blend(spark, sf):
    e = _embeddings(spark, sf).select("vec_id", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"), (F.col("vec_id") % 3 != 1).alias("covered"))

    def score(q, r):
        both = q["covered"][:, None].astype(bool) & r["covered"][None, :].astype(bool)
        return retrieval.covered_blend(retrieval.angular_scores(q["a"], r["a"]), retrieval.angular_scores(q["b"], r["b"]), both)

    return _found(retrieval.best_matches(e.filter(ASK), e, "vec_id", ["a", "b", "covered"], score, 20))


@query("joined_vectors", EMB + f", s AS (SELECT q.vec_id AS query, e.vec_id, 0.7 * list_dot_product(q.v[1:32], e.v[1:32]) + 0.3 * list_dot_product(q.v[33:64], e.v[33:64]) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) {_ROUND} (SELECT *, {_RANK} AS rank FROM s) WHERE rank <= 20")
def joined_vectors(spark, sf):
    e = _embeddings(spark, sf).select("vec_id", joined(F.slice("v", 1, 32), F.slice("v", 33, 32), 0.3).alias("v"))
    return _found(retrieval.best_matches(e.filter(ASK), e, "vec_id", ["v"], lambda q, r: retrieval.scores(q["v"], r["v"]), 20))


@query("ruzicka_overlap", EMB + f""", c AS (SELECT vec_id, [greatest(x, 0.0) for x in v] AS v FROM e),
s AS (SELECT q.vec_id AS query, c.vec_id, list_sum([least(p[1], p[2]) for p in list_zip(q.v, c.v)]) / nullif(list_sum([greatest(p[1], p[2]) for p in list_zip(q.v, c.v)]), 0) AS score FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) {_ROUND} (SELECT *, {_RANK} AS rank FROM s) WHERE rank <= 20""")
def ruzicka_overlap(spark, sf):
    e = _embeddings(spark, sf).select("vec_id", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))).alias("v"))
    return _found(retrieval.best_matches(e.filter(ASK), e, "vec_id", ["v"], lambda q, r: retrieval.overlaps(q["v"], r["v"]), 20))


@query("top_pairs", EMB + """, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label <> b.label)
SELECT a, b, round(c, 6) AS cosine FROM p ORDER BY c DESC, a, b LIMIT 50""")
def top_pairs(spark, sf):
    return retrieval.top_pairs(_embeddings(spark, sf), "vec_id", "v", "label", 50).select("a", "b", F.round("cosine", 6).alias("cosine"))


NEIGHBOURS = EMB + """, p AS (SELECT a.vec_id AS q, b.vec_id AS c, a.label = b.label AS hit, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM p)"""


@query("retrieval_metrics", NEIGHBOURS + """, f AS (SELECT q, min(r) FILTER (hit) AS r FROM k GROUP BY q)
SELECT count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, CAST(median(r) AS DOUBLE) AS median_rank FROM f""")
def retrieval_metrics(spark, sf):
    e = _embeddings(spark, sf)
    first = retrieval.first_hit_rank(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "v", "label")
    return retrieval.retrieval_metrics(first, "query", "r", (1, 5)).select("queries", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "mrr")], "median_rank")


@query("neighbor_jaccard", EMB + """, n AS (SELECT q, c, h FROM (SELECT a.vec_id AS q, b.vec_id AS c, h, row_number() OVER (PARTITION BY a.vec_id, h ORDER BY list_dot_product(a.v[h:h + 31], b.v[h:h + 31]) / sqrt(list_dot_product(a.v[h:h + 31], a.v[h:h + 31]) * list_dot_product(b.v[h:h + 31], b.v[h:h + 31])) DESC, b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id, (SELECT unnest([1, 33]) AS h)) WHERE r <= 10)
SELECT q AS query, round((count(*) - count(DISTINCT c)) / count(DISTINCT c), 6) AS jaccard FROM n GROUP BY q""")
def neighbor_jaccard(spark, sf):
    half = lambda at: _embeddings(spark, sf).select("vec_id", F.slice("v", at, 32).alias("v"))
    lists = [retrieval.top_matches(half(at), half(at), "vec_id", "v", 10) for at in (1, 33)]
    return evaluate.jaccard_at(*lists, "query", "vec_id").select("query", F.round("jaccard", 6).alias("jaccard"))


@query("calibration_quantiles", SCORED + """, g AS (SELECT query, round(score, 4) AS score FROM s), n AS (SELECT max(score) AS m FROM g GROUP BY query)
SELECT round(quantile_cont(score, 0.05), 6) AS q5, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.95), 6) AS q95, round(avg(CASE WHEN score > 0.5 THEN 1.0 ELSE 0 END), 6) AS above_50, (SELECT round(quantile_cont(m, 0.5), 6) FROM n) AS nearest_q50, (SELECT round(quantile_cont(m, 0.95), 6) FROM n) AS nearest_q95 FROM g""")
def calibration_quantiles(spark, sf):
    """Quantiles of the scores of all queries with all other rows, and of those with the nearest other; scores have four digits."""
    e = _embeddings(spark, sf)
    counted = kept(retrieval.counted_scores(e.filter(ASK), e, "vec_id", ["v"], _angular), "counted-scores")
    near = evaluate.quantiles(counted.groupBy("query").agg(F.max("score").alias("score")), "score", (0.5, 0.95), ()).withColumnsRenamed({"q50": "nearest_q50", "q95": "nearest_q95"})
    out = evaluate.quantiles(counted, "score", (0.05, 0.5, 0.95), (0.5,), weight="n").join(F.broadcast(near))  # a row each
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


WEIGHTS = {"games": 1.0, "total": 2.0, "c_acctbal": 0.5}
PCT = {c: RANK.format(g="c_nationkey", v=c, o="ASC") for c in WEIGHTS}
NEAR = CUSTOMERS + ", p AS (SELECT c_custkey, " + ", ".join(f"{PCT[c]} AS {c}" for c in WEIGHTS) + " FROM f), s AS (SELECT z.c_custkey AS query, p.c_custkey, " + ", ".join(f"{w} * (p.{c} - z.{c}) ** 2 AS g_{c}" for c, w in WEIGHTS.items()) + " FROM p JOIN p z ON p.c_custkey <> z.c_custkey WHERE z.c_custkey % 50 = 0), d AS (SELECT *, round(greatest(0, least(1, 1 - sqrt((" + " + ".join(f"g_{c}" for c in WEIGHTS) + f") / {sum(WEIGHTS.values())}))), 9) AS score FROM s), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, c_custkey) AS rank FROM d) WHERE rank <= 10)"


def _percentile_vectors(spark, sf):
    rows = windows.percentiles(_customers(spark, sf).select("c_custkey", "c_nationkey", *WEIGHTS), ["c_custkey"], dict.fromkeys(WEIGHTS, True), ["c_nationkey"])
    return kept(rows.select("c_custkey", F.array(*[F.col(f"pct_{c}") for c in WEIGHTS]).alias("v")), "percentile-vectors")


def _similar(spark, sf):
    """Customers by percentiles, and the ten most alike of those whose key is divisible by 50."""
    rows, weights = _percentile_vectors(spark, sf), list(WEIGHTS.values())
    return rows, retrieval.closest(rows.filter("c_custkey % 50 = 0"), rows, "c_custkey", "v", weights, 10)


PRESETS = {"even": {}, "volume": {"total": 3.0, "games": 1.5}}
_PRESET = CUSTOMERS + ", p AS (SELECT c_custkey, " + ", ".join(f"{PCT[c]} AS {c}" for c in WEIGHTS) + " FROM f), w AS (SELECT * FROM (VALUES ('even', 1.0, 1.0, 1.0), ('volume', 1.5, 3.0, 1.0)) AS t(preset, a, b, c)), s AS (SELECT preset, z.c_custkey AS query, p.c_custkey, round(greatest(0, least(1, 1 - sqrt((a * (p.games - z.games) ** 2 + b * (p.total - z.total) ** 2 + c * (p.c_acctbal - z.c_acctbal) ** 2) / (a + b + c)))), 9) AS score FROM p JOIN p z ON p.c_custkey <> z.c_custkey, w)"


@query("preset_similarity", _PRESET + " SELECT preset, query, c_custkey, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY preset, query ORDER BY score DESC, c_custkey) AS rank FROM s) WHERE rank <= 5")
def preset_similarity(spark, sf):
    """The five most alike of every customer under each preset of weights."""
    rows, found = _percentile_vectors(spark, sf), []
    for name in PRESETS:
        weights = retrieval.preset_weights(PRESETS, name, list(WEIGHTS))
        top = space.closest_of_all(rows, "c_custkey", "v", weights, 5)
        found.append(top.select(F.lit(name).alias("preset"), "query", "c_custkey", F.round("score", 6).alias("score"), "rank"))
    return found[0].unionByName(found[1])


@query("weighted_similarity_topk", NEAR + " SELECT query, c_custkey, round(score, 6) AS score FROM b")
def weighted_similarity_topk(spark, sf):
    return _similar(spark, sf)[1].select("query", "c_custkey", F.round("score", 6).alias("score"))


@query("contribution_shares", NEAR + ", u AS (SELECT query, c_custkey, unnest(['games', 'total', 'c_acctbal']) AS feature, unnest([g_games, g_total, g_c_acctbal]) AS g, g_games + g_total + g_c_acctbal AS t FROM b) SELECT query, c_custkey, feature, round(g / nullif(t, 0), 6) AS share FROM u")
def contribution_shares(spark, sf):
    rows, found = _similar(spark, sf)
    both = found.join(rows, "c_custkey").join(rows.select(F.col("c_custkey").alias("query"), F.col("v").alias("q")), "query")
    gaps = F.zip_with(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.array(*[F.lit(x) for x in WEIGHTS.values()]), lambda g, x: g * x)
    s = both.select("query", "c_custkey", gaps.alias("gaps")).withColumn("t", F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x))
    long = s.select("query", "c_custkey", "t", F.posexplode("gaps").alias("i", "g"))
    return long.select("query", "c_custkey", F.get(F.array(*[F.lit(c) for c in WEIGHTS]), F.col("i")).alias("feature"), F.round(F.try_divide("g", F.nullif("t", F.lit(0.0))), 6).alias("share"))


LABELLED = "WITH d AS (SELECT l.quality AS y, n_chars AS s, doc_id FROM labels l JOIN documents USING (doc_id))"


@query("auc_ap_topn", LABELLED + """, t AS (SELECT s, sum(y) AS p, count(*) AS n FROM d GROUP BY s), c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS al FROM t)
SELECT round(sum((n - p) * (tp - p / 2)) / nullif(sum(p) * sum(n - p), 0), 6) AS roc_auc, round(sum(p * tp / al) / sum(p), 6) AS average_precision, (SELECT round(avg(y), 6) FROM (SELECT y FROM d ORDER BY s DESC, doc_id LIMIT 20)) AS precision FROM c""")
def auc_ap_topn(spark, sf):
    d = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    both = evaluate.ranking_quality(d, "n_chars", "quality").join(evaluate.precision_at(d, "n_chars", "quality", "doc_id", 20))
    return both.select(*[F.round(c, 6).alias(c) for c in ("roc_auc", "average_precision", "precision")])


@query("spearman_p80", """WITH o AS (SELECT o_totalprice AS y, CAST(o_orderkey % 1000 * 500 AS DOUBLE) AS p FROM orders),
r AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp FROM o)
SELECT round(avg(abs(p - y)), 2) AS mae, round(sqrt(avg((p - y) ** 2)), 2) AS rmse, round(quantile_cont(abs(p - y), 0.8), 2) AS error_quantile, round(corr(ry, rp), 6) AS rank_correlation FROM r""")
def spearman_p80(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 1000 * 500).cast("double").alias("p"))
    both = evaluate.regression_errors(o, "y", "p").join(evaluate.rank_correlation(o, "y", "p"))
    return both.select(*[F.round(c, 2).alias(c) for c in ("mae", "rmse", "error_quantile")], F.round("rank_correlation", 6).alias("rank_correlation"))


@query("nnls_slope", "SELECT round(greatest(0, regr_slope(o_totalprice, o_orderkey)), 8) AS slope, round(CASE WHEN regr_slope(o_totalprice, o_orderkey) > 0 THEN regr_intercept(o_totalprice, o_orderkey) ELSE avg(o_totalprice) END, 3) AS intercept FROM orders")
def nnls_slope(spark, sf):
    out = evaluate.non_negative_line(read(spark, sf, "orders"), "o_orderkey", "o_totalprice")
    return out.select(F.round("slope", 8).alias("slope"), F.round("intercept", 3).alias("intercept"))


FUZZY = """WITH p AS (SELECT p_partkey, p_name, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS f, string_split(lower(p_name), ' ') AS ws FROM part),
t AS (SELECT *, CASE WHEN f = 'wiget' OR list_contains(ws, 'wiget') THEN 0 WHEN list_bool_or([starts_with(w, 'wiget') for w in ws]) THEN 1 WHEN contains(f, 'wiget') THEN 2 ELSE 3 END AS priority, list_min([levenshtein(w, 'wiget') for w in list_append(ws, f)]) AS near FROM p),
d AS (SELECT *, CASE WHEN priority < 3 THEN 0 ELSE near END AS distance FROM t)
SELECT p_partkey, p_name, priority, CAST(distance AS INTEGER) AS distance FROM d WHERE distance <= 2 AND (priority < 3 OR (SELECT min(priority) FROM d WHERE distance <= 2) = 3)"""


@query("fuzzy_names", FUZZY)
def fuzzy_names(spark, sf):
    return names.search(read(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "wiget", ascii_only=True)


@query("folded_names", FUZZY.replace("wiget", "ring"))
def folded_names(spark, sf):
    return names.search(read(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "Rïng")


@query("number_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '(?:^|[^\\w.-])(-?\\d+(?:\\.\\d+)?)', 1))) AS n_numbers FROM documents")
def number_tokens(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(text.numbers(F.col("text"))).cast("long").alias("n_numbers"))


@query("name_labels", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || ' (' || min(p_size) OVER (PARTITION BY p_name) || '-' || max(p_size) OVER (PARTITION BY p_name) || ')' ELSE p_name END AS label FROM part")
def name_labels(spark, sf):
    w = Window.partitionBy("p_name")
    span = F.concat("p_name", F.lit(" ("), F.min("p_size").over(w).cast("string"), F.lit("-"), F.max("p_size").over(w).cast("string"), F.lit(")"))
    return read(spark, sf, "part").select("p_partkey", F.when(F.count("*").over(w) > 1, span).otherwise(F.col("p_name")).alias("label"))


@query("binned_aggregation", "SELECT CAST(CASE WHEN p_size > 30 THEN 2 WHEN p_size > 15 THEN 1 ELSE 0 END AS INTEGER) AS bin, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1")
def binned_aggregation(spark, sf):
    return read(spark, sf, "part").groupBy(evaluate.bins(F.col("p_size"), [15, 30]).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("knn_cv", EMB + """, p AS (SELECT a.vec_id AS query, b.label AS y, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s, b.vec_id AS c FROM e a JOIN e b ON a.vec_id % 5 <> b.vec_id % 5),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, c) AS r FROM p) SELECT query, round(sum(y / (1 - s + 0.01)) / sum(1 / (1 - s + 0.01)), 5) AS predicted FROM k WHERE r <= 15 GROUP BY query""")
def knn_cv(spark, sf):
    """Five-fold predictions of the label by the 15 nearest vectors of other folds."""
    e = _embeddings(spark, sf).withColumn("fold", F.col("vec_id") % 5)
    found = retrieval.top_matches(e, e, "vec_id", "v", 15, carry=["label"], apart="fold")
    weight = 1 / (1 - F.col("cosine") + 0.01)
    return found.groupBy("query").agg(F.round(F.sum(F.col("label") * weight) / F.sum(weight), 5).alias("predicted"))


@query("logistic_fit")
def logistic_fit(spark, sf):
    d = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("n_lines")), "doc_id")
    model, data = models.balanced_logistic(d, ["n_chars", "n_lines"], "quality")
    return model.transform(data).select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))


@query("ridge_fit")
def ridge_fit(spark, sf):
    model, data = models.penalised_line(_customers(spark, sf), ["games", "c_acctbal"], "total", 12.0 / 1000, 0.15)
    return model.transform(data).select("c_custkey", "total", F.round("prediction", 4).alias("predicted"))
