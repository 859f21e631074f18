"""Queries over seasons, coverage, pairs and choices within groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import labels, ratios
from tallyforge.operators import aggregate, joins, windows
from tallyforge.plans.base import query, read

SEASON = "CASE WHEN month(d) >= 9 THEN year(d) ELSE year(d) - 1 END"
LABEL = "printf('%04d-%02d', s, (s + 1) % 100)"
ORDERS = f"o AS (SELECT *, {LABEL} AS season FROM (SELECT *, {SEASON} AS s FROM (SELECT *, o_orderdate AS d FROM orders)))"


def _orders(spark, sf):
    return read(spark, sf, "orders").withColumn("season", labels.season_of(F.col("o_orderdate")))


@query("season_label", f"WITH {ORDERS} SELECT season, count(*) AS n, min(o_orderkey) AS first_key FROM o GROUP BY season")
def season_label(spark, sf):
    return _orders(spark, sf).groupBy("season").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("season_type_rules", """
SELECT o_orderkey, CASE WHEN t IS NULL OR t = 'unknown' THEN 'unknown' WHEN regexp_matches(t, 'all.star') THEN 'all_star' WHEN contains(t, 'playoff') THEN 'playoffs' WHEN contains(t, 'in-season tournament') OR contains(t, 'in season tournament') OR contains(t, 'regular') THEN 'regular' ELSE 'other' END AS season_type,
  CASE substr(g, 1, 3) WHEN '002' THEN 'regular' WHEN '004' THEN 'playoffs' WHEN '001' THEN 'preseason' ELSE 'other' END AS game_type
FROM (SELECT o_orderkey, lower(['Regular Season', 'Playoffs', 'All-Star Game', 'In-Season Tournament', 'in season tournament', 'Unknown', NULL, 'Exhibition'][o_orderkey % 8 + 1]) AS t,
  CASE o_orderstatus WHEN 'F' THEN '0020000001' WHEN 'O' THEN '0040000001' ELSE '0010000001' END AS g FROM orders)""")
def season_type_rules(spark, sf):
    kinds = ["Regular Season", "Playoffs", "All-Star Game", "In-Season Tournament", "in season tournament", "Unknown", None, " Exhibition "]
    p = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 8).cast("int"))
    g = F.when(F.col("o_orderstatus") == "F", "20000001.0").when(F.col("o_orderstatus") == "O", "40000001").otherwise("10000001")
    return read(spark, sf, "orders").select("o_orderkey", labels.season_type(p).alias("season_type"), labels.game_id_type(g).alias("game_type"))


@query("activity_filter", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE coalesce(nullif(l_tax, 0.0), 0) > 0 OR nullif(l_discount, 0.0) IS NOT NULL GROUP BY l_returnflag")
def activity_filter(spark, sf):
    tax, discount = F.nullif(F.col("l_tax"), F.lit(0.0)), F.nullif(F.col("l_discount"), F.lit(0.0))
    active = (F.coalesce(tax, F.lit(0.0)) > 0) | (F.greatest(F.lit(0.0), F.abs(F.coalesce(discount, F.lit(0.0)))) > 0)
    return read(spark, sf, "lineitem").filter(active).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


SEASON_TOTALS = f"""WITH {ORDERS}, r AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM o)
SELECT o_custkey, season, count(*) AS games, round(sum(price), 2) AS price_total, round(sum(coalesce(price, 0)) / nullif(count(price), 0), 4) AS price_per_game FROM r GROUP BY o_custkey, season"""


def _season_rows(spark, sf):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return _orders(spark, sf).select("o_custkey", "season", price.alias("price"))


def _season_out(df):
    return df.select("o_custkey", "season", "games", F.round("price_total", 2).alias("price_total"), F.round("price_rate", 4).alias("price_per_game"))


@query("season_aggregate", SEASON_TOTALS)
def season_aggregate(spark, sf):
    parts = aggregate.partials(_season_rows(spark, sf), ["o_custkey", "season"], ["price"], "price")
    return _season_out(parts.withColumn("price_rate", ratios.ratio(F.col("price_sum"), F.col("price_observed"))))


@query("incremental_partials", SEASON_TOTALS)
def incremental_partials(spark, sf):
    rows, keys = _season_rows(spark, sf), ["o_custkey", "season"]
    late = F.col("season") >= "1998-99"
    parts = aggregate.partials(rows.filter(~late), keys, ["price"], "price").unionByName(aggregate.partials(rows.filter(late), keys, ["price"], "price"))
    merged = aggregate.merge_partials(parts, keys)
    return _season_out(merged.withColumn("price_rate", ratios.ratio(F.col("price_sum"), F.col("price_observed"))))


@query("safe_ratios", """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) AS unit_price, round(avg(coalesce(l_tax / nullif(l_discount, 0), 0)), 6) AS tax_rate, round(avg(l_tax / nullif(l_discount, 0)), 6) AS tax_rate_seen,
  round((sum(l_quantity) + 0.5 * sum(l_linenumber)) / nullif(sum(l_quantity), 0), 6) AS effective, round(sum(l_extendedprice) / (2.0 * (sum(l_quantity) + 0.44 * sum(l_linenumber))), 6) AS true_rate
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def safe_ratios(spark, sf):
    c = F.col
    q, n = F.sum("l_quantity"), F.sum("l_linenumber")
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(ratios.ratio(c("l_extendedprice"), c("l_quantity"))), 6).alias("unit_price"),
        F.round(F.avg(ratios.ratio(c("l_tax"), c("l_discount"), 0)), 6).alias("tax_rate"),
        F.round(F.avg(ratios.ratio(c("l_tax"), c("l_discount"))), 6).alias("tax_rate_seen"),
        F.round(ratios.effective_rate(q, n, q), 6).alias("effective"),
        F.round(ratios.true_rate(F.sum("l_extendedprice"), q, n), 6).alias("true_rate"),
    )


@query("coverage_full_outer", """
WITH k AS (SELECT year(o_orderdate) AS y, 'a' AS s FROM orders UNION ALL SELECT year(l_shipdate), 'b' FROM lineitem UNION ALL SELECT year(ts), 'c' FROM events)
SELECT y AS season, nullif(count(*) FILTER (s = 'a'), 0) AS order_rows, nullif(count(*) FILTER (s = 'b'), 0) AS line_rows, nullif(count(*) FILTER (s = 'c'), 0) AS event_rows FROM k GROUP BY y""")
def coverage_full_outer(spark, sf):
    year = lambda t, c: read(spark, sf, t).select(F.year(c).cast("long").alias("season"))
    return joins.coverage({"order_rows": year("orders", "o_orderdate"), "line_rows": year("lineitem", "l_shipdate"), "event_rows": year("events", "ts")}, ["season"])


SIDES = """WITH t AS (SELECT n_regionkey AS team, CAST(o_orderdate AS DATE) AS game, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS score, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def _sides(spark, sf):
    o, c, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    cents = F.round(F.sum("o_totalprice") * 100).cast("long")
    return rows.groupBy(F.col("n_regionkey").alias("team"), F.to_date("o_orderdate").alias("game")).agg(cents.alias("score"), F.count("*").alias("n")).withColumn("opponent", (F.col("team") + 1) % 5)


@query("opponent_pairing", SIDES + """
SELECT a.team, CAST(a.game AS VARCHAR) AS game, a.score, b.score AS opponent_score, b.n AS opponent_n FROM t a LEFT JOIN t b ON a.game = b.game AND b.team = (a.team + 1) % 5""")
def opponent_pairing(spark, sf):
    paired = joins.pair_sides(_sides(spark, sf), ["game"], "team", "opponent", ["score", "n"])
    return paired.select("team", F.col("game").cast("string").alias("game"), "score", "opponent_score", "opponent_n")


@query("league_rank", SIDES + """, p AS (SELECT a.team, year(a.game) AS season, a.score AS s, b.score AS o FROM t a JOIN t b ON a.game = b.game AND b.team = (a.team + 1) % 5),
g AS (SELECT team, season, count(*) AS games, count(*) FILTER (s > o) AS wins FROM p GROUP BY 1, 2)
SELECT season, team, games, wins, round(wins / games, 6) AS win_share, row_number() OVER (PARTITION BY season ORDER BY wins / games DESC, team) AS league_rank FROM g""")
def league_rank(spark, sf):
    paired = joins.pair_sides(_sides(spark, sf), ["game"], "team", "opponent", ["score"]).filter(F.col("opponent_score").isNotNull())
    table = paired.groupBy(F.year("game").cast("long").alias("season"), "team").agg(F.count("*").alias("games"), F.count_if(F.col("score") > F.col("opponent_score")).alias("wins"))
    share = F.col("wins") / F.col("games")
    return windows.pick(table.withColumn("win_share", F.round(share, 6)), ["season"], [share.desc(), F.col("team")], 1 << 30, "league_rank").select("season", "team", "games", "wins", "win_share", F.col("league_rank").cast("long").alias("league_rank"))


@query("latest_per_key", "SELECT o_custkey, max(o_orderdate) AS last_date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY o_custkey")
def latest_per_key(spark, sf):
    place = F.struct("o_orderdate", "o_orderkey")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"), F.max_by("o_orderkey", place).alias("last_key"), F.max_by("o_orderstatus", place).alias("last_status"))


@query("first_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_key(spark, sf):
    return windows.pick(read(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("topn_per_group", """
WITH t AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey, o_orderkey, qty, r AS place FROM (SELECT o_custkey, o_orderkey, qty, row_number() OVER (PARTITION BY o_custkey ORDER BY qty DESC, o_orderkey) AS r FROM t JOIN orders ON o_orderkey = l_orderkey) WHERE r <= 3""")
def topn_per_group(spark, sf):
    qty = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"))
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderkey").join(qty, "o_orderkey")
    out = windows.pick(rows, ["o_custkey"], [F.desc("qty"), F.col("o_orderkey")], 3, "place")
    return out.select("o_custkey", "o_orderkey", "qty", F.col("place").cast("long").alias("place"))


@query("recent_then_ascending", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""")
def recent_then_ascending(spark, sf):
    recent = windows.pick(read(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    out = windows.pick(recent, ["user_id"], [F.col("ts"), F.col("event_id")], 5, "nth")
    return out.select("user_id", "event_id", F.col("nth").cast("long").alias("nth"))


@query("semi_allow_list", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_allow_list(spark, sf):
    allowed = read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.only_listed(read(spark, sf, "customer").select("c_custkey", "c_name"), allowed, "c_custkey")


@query("anti_missing", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_missing(spark, sf):
    return joins.missing(read(spark, sf, "customer").select("c_custkey", "c_name"), read(spark, sf, "orders"), "c_custkey", "o_custkey")


YEARS = "y AS (SELECT o_custkey, year(o_orderdate) AS yr, count(*) AS n FROM orders GROUP BY 1, 2)"


def _years(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("yr")).agg(F.count("*").alias("n"))


@query("band_join_adjacent", f"WITH {YEARS} SELECT a.o_custkey, a.yr, a.n, round(avg(b.n), 6) AS near FROM y a LEFT JOIN y b ON a.o_custkey = b.o_custkey AND abs(a.yr - b.yr) = 1 GROUP BY 1, 2, 3")
def band_join_adjacent(spark, sf):
    return joins.neighbours_in_band(_years(spark, sf), "o_custkey", "yr", 1, "n", "near").select("o_custkey", "yr", "n", F.round("near", 6).alias("near"))


@query("lead_adjacent_pairs", f"WITH {YEARS} SELECT o_custkey, yr, n, n2 AS next_n FROM (SELECT *, lead(yr) OVER w AS y2, lead(n) OVER w AS n2 FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY yr)) WHERE y2 = yr + 1")
def lead_adjacent_pairs(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("yr")
    rows = _years(spark, sf).withColumn("y2", F.lead("yr").over(w)).withColumn("next_n", F.lead("n").over(w))
    return rows.filter("y2 = yr + 1").select("o_custkey", "yr", "n", "next_n")


@query("scalar_subquery_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def scalar_subquery_latest(spark, sf):
    return spark.sql("SELECT o_custkey, o_orderkey, o_totalprice FROM {o} WHERE o_orderdate = (SELECT max(o_orderdate) FROM {o})", o=read(spark, sf, "orders"))


@query("diversity_cap", """
SELECT s_suppkey, s_nationkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 2 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20""")
def diversity_cap(spark, sf):
    return windows.capped(read(spark, sf, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.col("s_suppkey")], 2, 20).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("union_aligned", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_aligned(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit(1).alias("extra"))
    return joins.union_aligned(c, s)


@query("season_intersection", "SELECT season FROM (SELECT year(o_orderdate) AS season FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 28 INTERSECT SELECT year(l_shipdate) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 28) ORDER BY season DESC LIMIT 5")
def season_intersection(spark, sf):
    usable = lambda t, d, k: read(spark, sf, t).groupBy(F.year(d).cast("long").alias("season")).agg(F.countDistinct(k).alias("n")).filter("n >= 28").select("season")
    return usable("orders", "o_orderdate", "o_custkey").intersect(usable("lineitem", "l_shipdate", "l_suppkey")).orderBy(F.desc("season")).limit(5)
