"""Queries over events, ranks, fills, mixes and pooled groups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.functions.ratios import clip, exact_sum, logistic, shrink
from tallyforge.functions.vectors import dense
from tallyforge.operators import aggregate, events, evidence, roster, team, windows
from tallyforge.plans.base import query, read
from tallyforge.plans.base import rounded as _rounded

#: The events table stands in for shots: its kinds become names, value / 10 the distance, even k in props a make.
KINDS = {"view": ("Restricted Area", "driving layup"), "click": ("In The Paint (Non-RA)", "hook shot"), "signup": ("Mid-Range", "pullup jump shot"), "purchase": ("Above the Break 3", "step back jump shot"), "error": ("Backcourt", "jump shot")}
SHOT_SQL = (
    "WITH e AS (SELECT event_id, user_id, event_type, value / 10 AS distance, CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 AS made, dayofweek(ts) IN (0, 6) AS weekend, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{z.lower()}'" for k, (z, _) in KINDS.items())
    + " END AS z, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{a}'" for k, (_, a) in KINDS.items())
    + """ END AS a FROM events), x AS (SELECT *, CASE WHEN contains(z, 'restricted') OR distance <= 4 THEN 'rim' WHEN contains(z, 'paint') THEN 'paint' WHEN contains(z, 'mid-range') THEN 'midrange' WHEN contains(z, '3') OR distance >= 23 THEN 'three_point' ELSE 'other' END AS zone,
  CASE WHEN contains(a, 'step back') THEN 'step_back' WHEN contains(a, 'pullup') THEN 'pull_up' WHEN contains(a, 'hook') THEN 'hook' WHEN contains(a, 'layup') THEN 'layup' ELSE 'other' END AS act FROM e)"""
)
ZONES = ["rim", "paint", "midrange", "three_point"]


def _shots(spark, sf):
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[i])]), F.col("event_type"))
    e = read(spark, sf, "events").withColumn("distance", F.col("value") / 10)
    made = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    return e.withColumns({"made": F.when(made, 1.0).otherwise(0.0), "weekend": F.dayofweek("ts").isin(1, 7), "zone": labels.zone(pick(0), F.col("distance")), "act": labels.action(pick(1))})


@query("zone_action_buckets", SHOT_SQL + " SELECT zone, act AS action, count(*) AS n, round(avg(distance), 6) AS distance FROM x GROUP BY zone, act")
def zone_action_buckets(spark, sf):
    return _shots(spark, sf).groupBy("zone", F.col("act").alias("action")).agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("distance"))


@query("expected_rate_profile", SHOT_SQL + """, m AS (SELECT avg(made::INT) AS m FROM x), c AS (SELECT zone, act, (sum(made::INT) + 25 * any_value(m)) / (count(*) + 25) AS p FROM x, m GROUP BY 1, 2)
SELECT user_id, count(*) AS tries, CAST(sum(made::INT) AS DOUBLE) AS hits, round(greatest(0, least(1, 1 - avg(p))), 6) AS difficulty, round(avg(made::INT) - avg(p), 6) AS above_expected FROM x JOIN c USING (zone, act) GROUP BY user_id""")
def expected_rate_profile(spark, sf):
    out = aggregate.expected_profile(_shots(spark, sf), "user_id", ["zone", "act"], "made")
    return out.select("user_id", "tries", "hits", F.round("difficulty", 6).alias("difficulty"), F.round("above_expected", 6).alias("above_expected"))


@query("zone_mix_pivot", SHOT_SQL + " SELECT user_id, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (zone = '{z}') / count(*), 6) AS {z}" for z in ZONES) + " FROM x GROUP BY user_id")
def zone_mix_pivot(spark, sf):
    out = aggregate.mix(_shots(spark, sf), ["user_id"], F.col("zone"), ZONES)
    return out.select("user_id", F.col("rows").alias("n"), *[F.round(z, 6).alias(z) for z in ZONES])


@query("mix_shift", SHOT_SQL + ", s AS (SELECT user_id, count(*) FILTER (weekend) AS we, count(*) FILTER (NOT weekend) AS wd, "
       + " + ".join(f"abs(count(*) FILTER (weekend AND zone = '{z}') / nullif(count(*) FILTER (weekend), 0) - count(*) FILTER (NOT weekend AND zone = '{z}') / nullif(count(*) FILTER (NOT weekend), 0))" for z in ZONES)
       + " AS d FROM x GROUP BY user_id) SELECT user_id, we AS weekend_rows, wd AS week_rows, CASE WHEN we >= 10 AND wd >= 10 THEN round(d, 6) END AS shift FROM s")
def mix_shift(spark, sf):
    side = F.when(F.col("weekend"), "weekend").otherwise("week")
    out = aggregate.mix_shift(_shots(spark, sf), ["user_id"], side, "weekend", "week", F.col("zone"), ZONES, (10, 10))
    return out.withColumn("shift", F.round("shift", 6))


@query("distance_flags_std", "SELECT event_type, round(avg(CASE WHEN value <= 40 THEN 1.0 ELSE 0 END), 6) AS near, round(avg(CASE WHEN value >= 230 THEN 1.0 ELSE 0 END), 6) AS far, round(stddev_pop(value / 10), 6) AS spread FROM events GROUP BY event_type")
def distance_flags_std(spark, sf):
    v = F.col("value")
    out = aggregate.flag_means(read(spark, sf, "events"), ["event_type"], {"near": v <= 40, "far": v >= 230}, {"spread": v / 10})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("near", "far", "spread")])


@query("weighted_share", "SELECT l_suppkey, sum(l_quantity) AS weight, " + ", ".join(f"round(sum(CASE WHEN l_returnflag = '{k}' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share_{k}" for k in "ANR") + ", count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def weighted_share(spark, sf):
    rows = read(spark, sf, "lineitem")
    shares = aggregate.weighted_shares(rows, ["l_suppkey"], "l_returnflag", list("ANR"), "l_quantity")
    out = shares.join(rows.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders")), "l_suppkey")
    return out.select("l_suppkey", "weight", *[F.round(f"share_{k}", 6).alias(f"share_{k}") for k in "ANR"], "orders")


@query("recent_vs_prior_trend", """
WITH e AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events),
w AS (SELECT *, least(5, n // 2) AS w FROM e WHERE n >= 6),
m AS (SELECT user_id, avg(value) FILTER (p <= w) AS recent, avg(value) FILTER (p > w AND p <= 2 * w) AS prior FROM w GROUP BY user_id)
SELECT user_id, round(recent, 4) AS recent, round(prior, 4) AS prior, CASE WHEN recent - prior > 1 THEN 'up' WHEN recent - prior < -1 THEN 'down' ELSE 'steady' END AS direction FROM m""")
def recent_vs_prior_trend(spark, sf):
    out = aggregate.recent_trend(read(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], "value", tolerance=1.0)
    return out.select("user_id", F.round("recent", 4).alias("recent"), F.round("prior", 4).alias("prior"), "direction")


@query("sequence_islands", """
WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR event_type = 'error' THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS q FROM e)
SELECT user_id, CAST(max(q) AS BIGINT) AS sequences, max(c) AS longest FROM (SELECT user_id, q, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY user_id""")
def sequence_islands(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts")
    rows = read(spark, sf, "events").withColumn("prev", F.lag("event_type").over(w))
    starts = F.coalesce(F.col("prev") != F.col("event_type"), F.lit(True)) | (F.col("event_type") == "error")
    runs = windows.islands(rows, ["user_id"], [F.col("ts")], starts).groupBy("user_id", "sequence").agg(F.count("*").alias("c"))
    return runs.groupBy("user_id").agg(F.max("sequence").alias("sequences"), F.max("c").alias("longest"))


TIMED = """WITH e AS (SELECT *, CAST(event_id % 3 AS INTEGER) AS period, 720.0 - CAST(event_id % 720 AS DOUBLE) AS secs FROM events),
l AS (SELECT *, event_type = 'error' AS r, lag(event_type) OVER w AS pt, lag(secs) OVER w AS ps FROM e WINDOW w AS (PARTITION BY user_id, period ORDER BY event_id)),
f AS (SELECT *, r OR pt IS NULL OR pt <> event_type AS nw FROM l), q AS (SELECT *, sum(nw::INT) OVER (PARTITION BY user_id, period ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS sq FROM f),
t AS (SELECT *, max(CASE WHEN nw THEN CASE WHEN r THEN secs ELSE coalesce(ps, secs) END END) OVER s - secs AS el, CASE WHEN bool_or(r) OVER s THEN 14.0 ELSE 24.0 END AS lim FROM q WINDOW s AS (PARTITION BY user_id, period, sq)),
v AS (SELECT *, el >= 0 AND el <= lim AS ok FROM t)"""


@query("sequence_timing", TIMED + " SELECT user_id, count(*) FILTER (ok) AS timed_rows, round(count(*) FILTER (ok AND el <= 6) / nullif(count(*) FILTER (ok), 0), 6) AS early_rate, round(count(*) FILTER (ok AND lim - el <= 4) / nullif(count(*) FILTER (ok), 0), 6) AS late_rate FROM v GROUP BY user_id")
def sequence_timing(spark, sf):
    e = read(spark, sf, "events").withColumn("period", (F.col("event_id") % 3).cast("int")).withColumn("secs", F.lit(720.0) - (F.col("event_id") % 720).cast("double"))
    timed = events.sequences(e, ["user_id", "period"], "event_id", "event_type", F.col("event_type") == "error", "secs")
    out = events.phase_rates(timed, ["user_id"])
    return out.select("user_id", "timed_rows", F.round("early_rate", 6).alias("early_rate"), F.round("late_rate", 6).alias("late_rate"))


RANK = "(rank() OVER (PARTITION BY {g} ORDER BY {v} {o}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2) / count(*) OVER (PARTITION BY {g})"


@query("pct_rank_avg", f"SELECT c_custkey, round({RANK.format(g='c_nationkey', v='c_acctbal', o='ASC')}, 6) AS pct, round({RANK.format(g='c_mktsegment', v='c_nationkey', o='ASC')}, 6) AS tied FROM customer")
def pct_rank_avg(spark, sf):
    c = read(spark, sf, "customer")
    rows = windows.percentiles(c.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"), ["c_custkey"], {"c_acctbal": True}, ["c_nationkey"])
    tied = windows.percentile_table(c, "c_nationkey", group=["c_mktsegment"]).withColumnRenamed("v", "c_nationkey")
    rows = windows.on_group(rows, tied, ["c_mktsegment", "c_nationkey"])
    return rows.select("c_custkey", F.round("pct_c_acctbal", 6).alias("pct"), F.round("pct", 6).alias("tied"))


@query("pct_rank_desc", f"SELECT s_suppkey, round({RANK.format(g='s_nationkey', v='s_acctbal', o='DESC')}, 6) AS pct FROM supplier")
def pct_rank_desc(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return windows.percentiles(rows, ["s_suppkey"], {"s_acctbal": False}, ["s_nationkey"]).select("s_suppkey", F.round("pct_s_acctbal", 6).alias("pct"))


@query("pct_rank_whole", "SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2) / count(*) OVER (), 6) AS pct FROM part")
def pct_rank_whole(spark, sf):
    p = read(spark, sf, "part")
    return p.join(windows.percentile_table(p, "p_size"), p["p_size"] == F.col("v")).select("p_partkey", F.round("pct", 6).alias("pct"))


@query("season_zscore", """
WITH t AS (SELECT o_custkey, year(o_orderdate) AS season, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT o_custkey, season, round((total - avg(total) OVER w) / nullif(stddev_samp(total) OVER w, 0), 5) AS z FROM t WINDOW w AS (PARTITION BY season)""")
def season_zscore(spark, sf):
    t = read(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("season")).agg(F.sum("o_totalprice").alias("total"))
    return team.feature_scores(t, "season", ["total"]).select("o_custkey", "season", F.round("z_total", 5).alias("z"))


NULLED = "WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part)"


def _nulled(spark, sf):
    return read(spark, sf, "part").withColumn("price", F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")))


@query("median_fill", NULLED + ", m AS (SELECT p_type, median(price) AS m FROM p GROUP BY p_type) SELECT p_partkey, round(coalesce(price, m, 0), 4) AS filled FROM p JOIN m USING (p_type)")
def median_fill(spark, sf):
    return windows.fill_median(_nulled(spark, sf), "price", ["p_type"], "filled").select("p_partkey", F.round("filled", 4).alias("filled"))


@query("shrink_to_mean", NULLED + """, m AS (SELECT p_type, sum(price * p_size) / nullif(sum(CASE WHEN price IS NOT NULL THEN p_size END), 0) AS m, avg(price) AS a FROM p GROUP BY p_type)
SELECT p_partkey, round(coalesce((price * p_size + 20 * m) / (p_size + 20), m), 4) AS smoothed, round((price * p_size + a * 150) / (p_size + 150), 4) AS shrunk FROM p JOIN m USING (p_type)""")
def shrink_to_mean(spark, sf):
    from pyspark.sql import Window

    rows = aggregate.reliability_smooth(_nulled(spark, sf), "p_type", "price", "p_size", 20.0)
    mean = F.avg("price").over(Window.partitionBy("p_type"))
    return rows.select("p_partkey", F.round("smoothed", 4).alias("smoothed"), F.round(shrink(F.col("price"), F.col("p_size"), mean, 150), 4).alias("shrunk"))


@query("half_split", "SELECT user_id, CASE WHEN r - 1 < n / 2 THEN 1 ELSE 2 END AS half, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1, 2")
def half_split(spark, sf):
    out = windows.halves(read(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return out.groupBy("user_id", F.col("half").cast("int").alias("half")).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


@query("odd_even", "SELECT user_id, CAST(r % 2 AS INTEGER) AS parity, count(*) AS rows, round(avg(value), 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1, 2")
def odd_even(spark, sf):
    out = windows.halves(read(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return out.groupBy("user_id", F.col("parity").cast("int").alias("parity")).agg(F.count("*").alias("rows"), F.round(F.avg("value"), 4).alias("value"))


CUSTOMERS = """WITH f AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, count(o_orderkey) AS games, coalesce(sum(o_totalprice), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def _customers(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("games"), exact_sum(F.col("o_totalprice")).alias("total"))
    return read(spark, sf, "customer").join(o, "c_custkey", "left").fillna({"games": 0, "total": 0.0})


P = {c: RANK.format(g="c_nationkey", v=c, o="ASC") for c in ("games", "total", "c_acctbal")}


@query("trait_blend", CUSTOMERS + f", p AS (SELECT *, {P['games']} AS pg, {P['total']} AS pt, {P['c_acctbal']} AS pa FROM f) SELECT c_custkey, round(least(1, greatest(0, 0.55 * pg + 0.30 * pt + 0.15 * pa)), 6) AS volume, round((pt + pa) / 2, 6) AS value FROM p")
def trait_blend(spark, sf):
    rows = windows.percentiles(_customers(spark, sf).select("c_custkey", "c_nationkey", "games", "total", "c_acctbal"), ["c_custkey"], dict.fromkeys(("games", "total", "c_acctbal"), True), ["c_nationkey"])
    rows = rows.withColumnsRenamed({"pct_games": "pg", "pct_total": "pt", "pct_c_acctbal": "pa"})
    return rows.select("c_custkey", F.round(clip(0.55 * F.col("pg") + 0.30 * F.col("pt") + 0.15 * F.col("pa")), 6).alias("volume"), F.round((F.col("pt") + F.col("pa")) / 2, 6).alias("value"))


@query("quality_proxy", CUSTOMERS + f", p AS (SELECT *, {P['total']} AS pt FROM f) SELECT c_custkey, round(0.5 + (pt - 0.5) * games / (games + 10.0), 6) AS quality, round(1 / (1 + exp(-c_acctbal / 2000)), 6) AS squashed, least(1.0, games / 50.0) AS reliability FROM p")
def quality_proxy(spark, sf):
    rows = windows.percentiles(_customers(spark, sf).select("c_custkey", "c_nationkey", "games", "total", "c_acctbal"), ["c_custkey"], {"total": True}, ["c_nationkey"]).withColumnRenamed("pct_total", "pt")
    quality = 0.5 + (F.col("pt") - 0.5) * F.col("games") / (F.col("games") + 10.0)
    return rows.select("c_custkey", F.round(quality, 6).alias("quality"), F.round(logistic(F.col("c_acctbal"), 2000.0), 6).alias("squashed"), F.least(F.lit(1.0), F.col("games") / 50.0).alias("reliability"))


POOL = """WITH r AS (SELECT l_suppkey, l_quantity AS w, l_discount * 10 AS q, l_tax AS t, l_orderkey, l_linenumber FROM lineitem)"""


@query("roster_pool", POOL + """, k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC) AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC) AS h FROM r)
SELECT l_suppkey, round(sum(w * t) / sum(w), 6) AS roster_t, round(sum(w * q) / sum(w), 6) AS rotation_quality, round(avg(q) FILTER (b <= 3), 6) AS top_three_quality, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_size, round(sum(w) FILTER (h <= 3) / sum(w), 6) AS top_three_share FROM k GROUP BY l_suppkey""")
def roster_pool(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("w"), (F.col("l_discount") * 10).alias("q"), F.col("l_tax").alias("t"))
    out = aggregate.pooled(rows, ["l_suppkey"], "w", ["t"], "q")
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("roster_t", "rotation_quality", "top_three_quality", "effective_size", "top_three_share")])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("entropy_herfindahl", f"""WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS p FROM s)
SELECT c_nationkey, round(-sum(p * ln(p)) / {math.log(len(SEGMENTS))}, 6) AS entropy, round(1 / sum(p * p), 6) AS effective FROM p GROUP BY c_nationkey""")
def entropy_herfindahl(spark, sf):
    m = aggregate.mix(read(spark, sf, "customer"), ["c_nationkey"], F.col("c_mktsegment"), SEGMENTS)
    return m.select("c_nationkey", F.round(aggregate.entropy([F.col(s) for s in SEGMENTS]), 6).alias("entropy"), F.round(1 / sum((F.col(s) * F.col(s) for s in SEGMENTS[1:]), F.col(SEGMENTS[0]) ** 2), 6).alias("effective"))


NATIONS = """WITH g AS (SELECT c_nationkey AS k, avg(c_acctbal) AS a, CAST(count(*) AS DOUBLE) AS b, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0 END) AS c FROM customer GROUP BY 1)"""


def _nations(spark, sf):
    b = F.avg(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0))
    return read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"), F.count("*").cast("double").alias("b"), b.alias("c"))


@query("nearest_groups", NATIONS + """, s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM g), d AS (SELECT x.k, sqrt(((x.a - r.a) / sa) ** 2 + ((x.b - r.b) / sb) ** 2 + ((x.c - r.c) / sc) ** 2) AS d FROM g x, g r, s WHERE r.k = 3 AND x.k <> 3)
SELECT k, round(d, 5) AS distance, round(1 / (1 + d), 5) AS similarity FROM d ORDER BY d, k LIMIT 5""")
def nearest_groups(spark, sf):
    return roster.nearest_groups(_nations(spark, sf), "k", ["a", "b", "c"], 3, 5).select("k", F.round("distance", 5).alias("distance"), F.round("similarity", 5).alias("similarity"))


@query("support_check", NATIONS + """, d AS (SELECT x.k, min(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2)) AS n FROM g x JOIN g y ON x.k <> y.k GROUP BY x.k), q AS (SELECT quantile_cont(n, 0.95) AS t FROM d)
SELECT k, round(n, 4) AS nearest, n <= t AS supported FROM d, q""")
def support_check(spark, sf):
    rows = _nations(spark, sf).select("k", dense([F.col("a"), F.col("b"), F.col("c")]).alias("v"))
    return roster.support(rows, "k", "v").select("k", F.round("nearest", 4).alias("nearest"), "supported")


_SUPPORT = """WITH h AS (SELECT (c_nationkey * 5 + c_custkey % 5)::BIGINT AS k, CASE WHEN c_nationkey % 6 <> 1 THEN avg(CAST(c_acctbal AS DOUBLE)) END AS a, CAST(count(*) AS DOUBLE) AS b, CAST(max(c_acctbal) - min(c_acctbal) AS DOUBLE) AS c FROM customer GROUP BY c_nationkey, c_custkey % 5),
n AS (SELECT (1000 + s_nationkey)::BIGINT AS k, avg(CAST(s_acctbal AS DOUBLE)) * 1.5 AS a, CAST(count(*) AS DOUBLE) AS b, CASE WHEN s_nationkey % 4 <> 2 THEN CAST(max(s_acctbal) - min(s_acctbal) AS DOUBLE) END AS c FROM supplier GROUP BY s_nationkey),
d AS (SELECT median(a) AS a, median(b) AS b, median(c) AS c FROM h), f AS (SELECT k, coalesce(h.a, d.a) AS a, coalesce(h.b, d.b) AS b, coalesce(h.c, d.c) AS c FROM h, d), g AS (SELECT k, coalesce(n.a, d.a) AS a, coalesce(n.b, d.b) AS b, coalesce(n.c, d.c) AS c FROM n, d),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM f), t AS (SELECT quantile_cont(m, 0.95) AS t FROM (SELECT x.k, min(sqrt(((x.a - y.a) / sa) ** 2 + ((x.b - y.b) / sb) ** 2 + ((x.c - y.c) / sc) ** 2)) AS m FROM f x JOIN f y ON x.k <> y.k, s GROUP BY x.k)),
p AS (SELECT x.k, sqrt(((x.a - y.a) / sa) ** 2 + ((x.b - y.b) / sb) ** 2 + ((x.c - y.c) / sc) ** 2) AS m, y.k AS o FROM g x, f y, s), q AS (SELECT k, min(m) AS m, arg_min(o, m) AS o FROM p GROUP BY k), r AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, min(c) AS lc, max(c) AS hc FROM h)
SELECT q.k, round(m, 6) AS nearest_distance, o AS nearest, round(t, 6) AS support_threshold, round(m / t, 6) AS distance_ratio, m <= t AS is_supported, concat_ws(',', CASE WHEN a < la THEN 'a below' WHEN a > ha THEN 'a above' END, CASE WHEN b < lb THEN 'b below' WHEN b > hb THEN 'b above' END, CASE WHEN c < lc THEN 'c below' WHEN c > hc THEN 'c above' END) AS violations FROM q JOIN n USING (k), t, r"""


@query("roster_support", _SUPPORT)
def roster_support(spark, sf):
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    spread = lambda x: (F.max(x) - F.min(x)).cast("double")
    past = c.groupBy("c_nationkey", (F.col("c_custkey") % 5).alias("m")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("a"), F.count("*").alias("b"), spread("c_acctbal").alias("c"))
    past = past.select((F.col("c_nationkey") * 5 + F.col("m")).cast("long").alias("k"), F.when(F.col("c_nationkey") % 6 != 1, F.col("a")).alias("a"), "b", "c")
    new = s.groupBy("s_nationkey").agg((F.avg(F.col("s_acctbal").cast("double")) * 1.5).alias("a"), F.count("*").alias("b"), spread("s_acctbal").alias("c"))
    new = new.select((1000 + F.col("s_nationkey")).cast("long").alias("k"), "a", "b", F.when(F.col("s_nationkey") % 4 != 2, F.col("c")).alias("c"))
    out = roster.assess_support(new, past, "k", ["a", "b", "c"])
    shown = F.array_join(F.transform("violations", lambda v: F.concat_ws(" ", v["feature"], v["direction"])), ",")
    return _rounded(out.withColumn("violations", shown), ["k"], 6)


@query("midrank_percentile", "SELECT c_custkey, round((count(s_suppkey) FILTER (s_acctbal < c_acctbal) + count(s_suppkey) FILTER (s_acctbal <= c_acctbal) + 1) / (2 * count(s_suppkey)), 6) AS midrank FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey")
def midrank_percentile(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), "c_acctbal")
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"), "s_acctbal")
    return windows.midrank(c, "c_acctbal", s, "s_acctbal", "n").filter("midrank IS NOT NULL").select("c_custkey", F.round("midrank", 6).alias("midrank"))


METRICS = [("games", "integer"), ("total", "number"), ("c_acctbal", "number")]


@query("evidence_rows", CUSTOMERS + """, u AS (SELECT c_custkey, 1 AS n, 'games' AS metric, CAST(games AS DOUBLE) AS value, CAST(games AS VARCHAR) AS shown FROM f
UNION ALL SELECT c_custkey, 2, 'c_acctbal', c_acctbal, CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) FROM f WHERE c_acctbal > 0)
SELECT c_custkey, 'E' || row_number() OVER (PARTITION BY c_custkey ORDER BY n) AS evidence_id, metric, value, shown FROM u""")
def evidence_rows(spark, sf):
    rows = _customers(spark, sf).withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return evidence.evidence_rows(rows, "c_custkey", [("games", "integer"), ("c_acctbal", "integer")])


@query("evidence_packets")
def evidence_packets(spark, sf):
    return evidence.packets(evidence.evidence_rows(_customers(spark, sf), "c_custkey", METRICS), "c_custkey")


@query("scouting_reports")
def scouting_reports(spark, sf):
    rules = {"games": (15, "Plays often"), "total": (2_000_000, "Produces in volume"), "c_acctbal": (5000, "Has a large reserve")}
    return evidence.reports(evidence.evidence_rows(_customers(spark, sf), "c_custkey", METRICS), "c_custkey", rules)


@query("melt_metrics", "SELECT user_id, unnest(['n', 'most', 'least']) AS metric, unnest([CAST(count(*) AS DOUBLE), max(value), min(value)]) AS value FROM events GROUP BY user_id")
def melt_metrics(spark, sf):
    rows = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.max("value").alias("most"), F.min("value").alias("least"))
    return evidence.melt(rows, ["user_id"], ["n", "most", "least"])


@query("minutes_waterfill", """WITH p AS (SELECT s_nationkey, s_suppkey, greatest(s_acctbal, 0) AS w FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY w DESC, s_suppkey) - 1 AS k, sum(w) OVER (PARTITION BY s_nationkey ORDER BY w DESC, s_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM p),
f AS (SELECT *, CASE WHEN coalesce(greatest(0, 240 - 48 * k) * w / nullif(rest, 0), 0) < 48 THEN k END AS free FROM o), h AS (SELECT *, coalesce(min(free) OVER (PARTITION BY s_nationkey), count(*) OVER (PARTITION BY s_nationkey)) AS capped FROM f), l AS (SELECT *, max(CASE WHEN k = capped THEN rest END) OVER (PARTITION BY s_nationkey) AS lft FROM h)
SELECT s_nationkey, s_suppkey, round(CASE WHEN w <= 0 THEN 0 WHEN k < capped THEN 48 ELSE (240 - 48 * capped) * w / lft END, 6) AS minutes FROM l""")
def minutes_waterfill(spark, sf):
    rows = read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("w"))
    return roster.fit_minutes(rows, "s_nationkey", "w").select("s_nationkey", "s_suppkey", F.round("minutes", 6).alias("minutes"))


def _rotations(spark, sf):
    """Rosters of about fifteen: customers of a nation with neighbouring keys. One in seven is new, some of those are forced."""
    k, bal = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    position = F.get(F.array(*[F.lit(x) for x in ("G", "G-F", "F", "F-C", "C")]), (k % 5).cast("int"))
    rows = read(spark, sf, "customer").select(F.format_string("%d/%d", "c_nationkey", F.floor(k / 375)).alias("roster"), "c_custkey", position.alias("position"), F.greatest(F.lit(0.0), bal / 10000).alias("quality"), (k % 37).cast("double").alias("minutes_per_game"), (k % 7 == 0).alias("new"), (k % 21 == 0).alias("forced"))
    fitted = roster.fit_minutes(rows.filter("not new"), "roster", "minutes_per_game", "base", cap=42.0).select("c_custkey", F.when(k % 11 != 3, F.col("base")).otherwise(0.0).alias("base"))
    return rows.join(fitted, "c_custkey", "left").drop("new")


@query("allocation")
def allocation(spark, sf):
    made = roster.allocate(_rotations(spark, sf), "roster", "c_custkey")
    return made.select("roster", F.explode("players").alias("x")).select("roster", F.col("x.player").alias("c_custkey"), "x.before", "x.after", "x.share")


@query("allocation_audit")
def allocation_audit(spark, sf):
    made = roster.allocate(_rotations(spark, sf), "roster", "c_custkey")
    return made.select("roster", F.explode("audit").alias("x")).select("roster", F.col("x.player").alias("c_custkey"), "x.requested", "x.open_used", "x.forced", "x.displaced", "x.blocked_by", "x.assigned", "x.unfilled")
