"""Minutes of simulated rosters, and how far a roster is from what was seen."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.operators.retrieval import block_pairs, matrix, side
from tallyforge.operators.windows import exact_quantiles


def fit_minutes(rosters: DataFrame, roster: str, weight: str, into: str = "minutes", total: float = 240.0, cap: float = 48.0) -> DataFrame:
    """Shares of `total` in proportion to weights, none above cap; what is cut off goes to the others of the roster.

    With weights in falling order, the first k rows are at the cap, for the least k such that the next row's share of
    what is left is below it. So one sorted window gives every row's minutes, whatever a roster's size.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    g = Window.partitionBy(roster)
    order = g.orderBy(F.desc("_w"))
    rows = rosters.withColumn("_w", w).withColumn("_k", F.row_number().over(order) - 1)
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    share = F.try_divide(F.greatest(F.lit(0.0), F.lit(total) - F.lit(cap) * F.col("_k")) * F.col("_w"), F.nullif(rest, F.lit(0.0)))
    rows = rows.withColumn("_rest", rest).withColumn("_free", F.coalesce(share, F.lit(0.0)) < cap)
    full = F.coalesce(F.min(F.when(F.col("_free"), F.col("_k"))).over(g), F.count("*").over(g))
    rows = rows.withColumn("_full", full)
    left = F.max(F.when(F.col("_k") == F.col("_full"), F.col("_rest"))).over(g)
    rows = rows.withColumn("_left", left)
    minutes = F.when(F.col("_w") <= 0, 0.0).when(F.col("_k") < F.col("_full"), F.lit(cap)).otherwise((F.lit(total) - F.lit(cap) * F.col("_full")) * F.col("_w") / F.col("_left"))
    return rows.withColumn(into, minutes).drop("_w", "_k", "_rest", "_free", "_full", "_left")


#: Minutes of a game, the most that one player gets, and the lead in quality that takes all of another's minutes.
GAME_MINUTES, MOST_MINUTES, FULL_LEAD = 240.0, 42.0, 0.20
SLIGHT = 1e-9


def _rotation(p: list[dict], total: float) -> dict:
    """players and audit of one roster; see allocate()."""
    m = [0.0 if x["new"] else x["base"] for x in p]
    start, left, records = list(m), max(0.0, total - sum(m)), []
    for i in sorted((i for i, x in enumerate(p) if x["new"]), key=lambda i: (-p[i]["q"], i)):
        own = p[i]
        used = min(own["wish"], left)
        want, lost = own["wish"] - used, []
        met = [j for j, x in enumerate(p) if j != i and m[j] > 0 and own["at"][0] in x["at"]]
        worse = [j for j in met if own["forced"] or p[j]["q"] < own["q"]]
        for j in sorted(worse, key=lambda j: (len(set(p[j]["at"])) > 1, m[j] * (0.5 + p[j]["q"]), j)):
            share = 1.0 if own["forced"] else min(1.0, max(0.0, (own["q"] - p[j]["q"]) / FULL_LEAD))
            moved = min(want, m[j] * share) if want > SLIGHT else 0.0
            want -= moved
            if moved > SLIGHT:
                lost.append({"player": p[j]["player"], "minutes": moved})
                m[j] -= moved
        m[i], left = used + sum(x["minutes"] for x in lost), left - used
        blocked = sorted((p[j]["q"], m[j], p[j]["player"]) for j in met if p[j]["q"] >= own["q"] and m[j] > 0)
        records.append((i, used, lost, [dict(zip(("quality", "minutes", "player"), x, strict=True)) for x in blocked]))

    # What is still open: w times the least level that uses it up, none above its ceiling. Those that fill up do so in the order of room / w.
    w = [x["mpg"] * (0.5 + x["q"]) for x in p]
    room = [max(0.0, (x["wish"] if x["new"] else MOST_MINUTES) - m[j]) for j, x in enumerate(p)]
    gap = total - sum(m)
    rest, weights = gap, sum(x for x in w if x > 0)
    for full, x, space in sorted((room[j] / w[j], w[j], room[j]) for j in range(len(p)) if w[j] > 0):
        if weights * full <= rest:  # all that are left reach this one's room
            rest, weights = rest - space, weights - x
    height = rest / weights if weights > SLIGHT else float("inf")
    final = [x + (min(room[j], height * w[j]) if gap > SLIGHT and w[j] > 0 else 0.0) for j, x in enumerate(m)]
    audit = [
        {"player": p[i]["player"], "requested": p[i]["wish"], "open_used": used, "forced": p[i]["forced"], "displaced": lost, "blocked_by": blocked, "assigned": final[i], "unfilled": max(0.0, p[i]["wish"] - final[i])}
        for i, used, lost, blocked in records
    ]
    order = sorted(range(len(p)), key=lambda j: (-final[j], p[j]["player"]))
    return {"players": [{"player": p[j]["player"], "before": start[j], "after": final[j], "share": final[j] / total} for j in order], "audit": audit}


def allocate(rosters: DataFrame, roster: str, key: str, total: float = GAME_MINUTES, most: int = 60) -> DataFrame:
    """One row a roster: players (player, before, after, share; most minutes first) and audit, a record a newcomer.

    rosters has roster, key, position ("G-F"), quality, minutes_per_game, base (minutes that an incumbent keeps, null for a newcomer)
    and forced. Newcomers come best first (ties by key). Each wants its minutes, at most 42. It takes open ones, then, in the order of
    (other positions than its first one too, minutes * (0.5 + quality)), from worse players who share its first position: of each the share
    (lead / 0.20, 0 to 1) of the minutes; a forced one takes from all, in full. Minutes still open go to all in proportion to
    minutes_per_game * (0.5 + quality) up to 42, to a newcomer up to its wish.

    audit has player, requested, open_used, forced, displaced (who lost how much), blocked_by (who was not worse, by
    quality and minutes), assigned and unfilled. Missing quality counts as 0.5, missing minutes as 0, a null forced as false. A
    roster of more than `most` players is an error, so its array is small; tasks take the rosters one by one.
    """
    c = F.col
    wish = F.least(F.lit(MOST_MINUTES), F.greatest(F.lit(0.0), F.coalesce(c("minutes_per_game").cast("double"), F.lit(0.0))))
    mpg = F.coalesce(c("minutes_per_game").cast("double"), F.lit(0.0))
    player = F.struct(
        c(key).alias("player"), F.split(F.coalesce("position", F.lit("N/A")), "-").alias("at"), F.coalesce(c("quality").cast("double"), F.lit(0.5)).alias("q"),
        mpg.alias("mpg"), wish.alias("wish"), c("base").isNull().alias("new"), F.coalesce(c("base").cast("double"), F.lit(0.0)).alias("base"), F.coalesce("forced", F.lit(False)).alias("forced"),
    )
    rows = rosters.groupBy(roster).agg(F.array_sort(F.collect_list(player)).alias("p"), F.count("*").alias("n"))
    rows = rows.select(roster, F.when(c("n") <= most, c("p")).otherwise(F.raise_error(F.lit(f"a roster has more than {most} players")).cast(rows.schema["p"].dataType)).alias("p"))
    kind = rosters.schema[key].dataType.simpleString()
    schema = (
        f"{roster} {rosters.schema[roster].dataType.simpleString()}, players array<struct<player: {kind}, before: double, after: double, share: double>>, "
        f"audit array<struct<player: {kind}, requested: double, open_used: double, forced: boolean, displaced: array<struct<player: {kind}, minutes: double>>, "
        f"blocked_by: array<struct<quality: double, minutes: double, player: {kind}>>, assigned: double, unfilled: double>>"
    )
    types = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_rotation(p, total) for p in b.column("p").to_pylist()]
            made = [pa.array([d[f] for d in done], types.field(f).type) for f in ("players", "audit")]
            yield pa.RecordBatch.from_arrays([b.column(roster), *made], [roster, "players", "audit"])

    return rows.mapInArrow(fold, schema)


def nearest_groups(groups: DataFrame, key: str, features: Sequence[str], value, n: int) -> DataFrame:
    """The n groups closest to one of them in standardised features, with similarity 1 / (1 + distance)."""
    stats = groups.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    ref = groups.filter(F.col(key) == value).select(*[F.col(c).alias(f"r_{c}") for c in features]).limit(1)
    both = groups.filter(F.col(key) != value).join(F.broadcast(stats)).join(F.broadcast(ref))  # a row each
    gap = sum((F.coalesce(F.try_divide(F.col(c) - F.col(f"r_{c}"), F.nullif(F.col(f"s_{c}"), F.lit(0.0))), F.lit(0.0)) ** 2 for c in features), F.lit(0.0))
    return both.withColumn("distance", F.sqrt(gap)).withColumn("similarity", 1 / (1 + F.col("distance"))).select(key, "distance", "similarity").orderBy("distance", key).limit(n)


def assess_support(new: DataFrame, history: DataFrame, key: str, features: Sequence[str], quantile: float = 0.95) -> DataFrame:
    """For each row of new: nearest_distance and nearest (key) in history, support_threshold, distance_ratio, is_supported, violations.

    Features are filled by history's medians and standardised by its means and population deviations (one that doesn't vary counts 0). The threshold is the quantile of
    the distances of history's rows to their nearest other. violations are the features outside history's range, with value, lowest,
    highest and direction; a null feature violates nothing. History of fewer than three rows is an error, as is a quantile outside 0 to 1.
    """
    if not 0 < quantile < 1:
        raise ValueError("the quantile must be between 0 and 1")
    if history.limit(3).count() < 3:
        raise ValueError("history needs three rows")
    as_doubles = lambda df: df.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    past, rows = as_doubles(history), as_doubles(new)
    long = past.unpivot([key], list(features), "feature", "x")
    middle = exact_quantiles(long, "x", [0.5], ["feature"]).agg(*[F.max(F.when(F.col("feature") == f, F.col("q0"))).alias(f"d_{f}") for f in features])
    fill = lambda df: df.join(F.broadcast(middle)).select(key, *[F.coalesce(f, f"d_{f}", F.lit(0.0)).alias(f) for f in features])
    filled = fill(past)
    stats = filled.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    z = [F.coalesce(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.nullif(F.col(f"s_{f}"), F.lit(0.0))), F.lit(0.0)) for f in features]
    scaled = lambda df: df.join(F.broadcast(stats)).select(key, F.array(*z).alias("v"))
    place, ask = scaled(filled), scaled(fill(rows))
    edge = support(place, key, "v", quantile).agg(F.max("threshold").alias("support_threshold"))
    kind = history.schema[key].dataType.simpleString()

    def scan(pair: pa.Table) -> pa.Table:
        q, r = side(pair, 0, key), side(pair, 1, key)
        a, b = matrix(q, "v"), matrix(r, "v")
        if not len(a) or not len(b):
            return pa.table({key: q.column(key).slice(0, 0), "d": pa.array([], pa.float64()), "n": r.column(key).slice(0, 0)})
        d = np.stack([np.sqrt(((row - b) ** 2).sum(axis=1)) for row in a])
        at = d.argmin(axis=1)
        return pa.table({key: q.column(key), "d": d[np.arange(len(a)), at], "n": r.column(key).take(pa.array(at))})

    near = block_pairs(ask, place, key).applyInArrow(scan, f"{key} {kind}, d double, n {kind}").groupBy(key).agg(F.min(F.struct("d", "n")).alias("b"))
    ends = past.agg(*[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features])
    out = [F.when((F.col(f) < F.col(f"lo_{f}")) | (F.col(f) > F.col(f"hi_{f}")), F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"lo_{f}").alias("lowest"), F.col(f"hi_{f}").alias("highest"), F.when(F.col(f) < F.col(f"lo_{f}"), "below").otherwise("above").alias("direction"))) for f in features]
    checked = rows.join(F.broadcast(ends)).select(key, F.array_compact(F.array(*out)).alias("violations"))
    both = near.join(F.broadcast(edge)).join(checked, key)
    ratio = F.when(F.col("support_threshold") > 0, F.col("b.d") / F.col("support_threshold")).otherwise(float("inf"))
    return both.select(key, F.col("b.d").alias("nearest_distance"), F.col("b.n").alias("nearest"), "support_threshold", ratio.alias("distance_ratio"), (F.col("b.d") <= F.col("support_threshold")).alias("is_supported"), "violations")


def support(groups: DataFrame, key: str, vector: str, quantile: float = 0.95) -> DataFrame:
    """Each group's distance to its nearest other, and whether that is within the given quantile of all.

    vector: array<double>. Distances come from pairs of blocks, one matrix product each.
    """
    kind = groups.schema[key].dataType.simpleString()

    def scan(pair: pa.Table) -> pa.Table:
        q, r = side(pair, 0, key), side(pair, 1, key)
        ks, ids = q.column(key).to_numpy(), r.column(key).to_numpy()
        a, b = matrix(q, vector), matrix(r, vector)
        near = np.full(len(ks), np.inf)
        for i in range(0, len(ks) if len(ids) else 0, 256):
            d = np.sqrt(((a[i : i + 256, None, :] - b[None, :, :]) ** 2).sum(axis=2))
            d[ks[i : i + 256, None] == ids[None, :]] = np.inf
            near[i : i + 256] = d.min(axis=1)
        return pa.table({key: q.column(key), "nearest": near})

    rows = groups.select(key, vector)
    found = block_pairs(rows, rows, key).applyInArrow(scan, f"{key} {kind}, nearest double")
    near = found.groupBy(key).agg(F.min("nearest").alias("nearest"))
    edge = exact_quantiles(near, "nearest", [quantile]).withColumnRenamed("q0", "threshold")
    return near.join(F.broadcast(edge)).withColumn("supported", F.col("nearest") <= F.col("threshold"))
