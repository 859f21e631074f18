"""Season totals, mergeable partials, mixes and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.ratios import ratio


def partials(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], observed: str) -> DataFrame:
    """Mergeable totals: rows, sums (null if nothing was observed), how often `observed` was."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("games"),
        *[F.sum(c).alias(f"{c}_total") for c in sums],
        F.sum(F.coalesce(F.col(observed), F.lit(0.0))).alias(f"{observed}_sum"),
        F.count(observed).alias(f"{observed}_observed"),
    )


def merge_partials(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def finish(totals: DataFrame, sums: Sequence[str], observed: str) -> DataFrame:
    """Per-game rates; the mean of `observed` is over the games in which it was."""
    rates = {f"{c}_per_game": ratio(F.col(f"{c}_total"), F.col("games")) for c in sums}
    rates[f"{observed}_per_game"] = ratio(F.col(f"{observed}_sum"), F.col(f"{observed}_observed"))
    return totals.withColumns(rates)


def mix(rows: DataFrame, keys: Sequence[str], kind: Column, kinds: Sequence[str], prefix: str = "") -> DataFrame:
    """Share of each kind among a group's rows, one column a kind, in one pass."""
    counts = [F.count_if(kind == k).alias(f"{prefix}{k}") for k in kinds]
    total = F.count("*").alias("_n")
    out = rows.groupBy(*keys).agg(total, *counts)
    return out.select(*keys, F.col("_n").alias(f"{prefix}rows"), *[ratio(F.col(prefix + k), F.col("_n")).alias(prefix + k) for k in kinds])


def mix_shift(rows: DataFrame, keys: Sequence[str], side: Column, left: str, right: str, kind: Column, kinds: Sequence[str], least: tuple[int, int]) -> DataFrame:
    """Sum of absolute differences of the mixes of two sides; null unless both have enough rows."""
    n = {s: F.count_if(side == s) for s in (left, right)}
    gaps = [F.abs(ratio(F.count_if((side == left) & (kind == k)), n[left]) - ratio(F.count_if((side == right) & (kind == k)), n[right])) for k in kinds]
    total = gaps[0]
    for g in gaps[1:]:
        total = total + g
    enough = (n[left] >= least[0]) & (n[right] >= least[1])
    return rows.groupBy(*keys).agg(n[left].alias(f"{left}_rows"), n[right].alias(f"{right}_rows"), F.when(enough, total).alias("shift"))


def expected_rates(events: DataFrame, cells: Sequence[str], hit: str, prior: float = 25.0) -> DataFrame:
    """Rate of each cell, pulled towards the overall one by `prior` tries."""
    counts = events.groupBy(*cells).agg(F.sum(hit).alias("_hits"), F.count(hit).alias("_tries"))
    overall = counts.agg((F.sum("_hits") / F.sum("_tries")).alias("_mean"))  # one row, from the cells
    rate = (F.col("_hits") + F.lit(prior) * F.col("_mean")) / (F.col("_tries") + F.lit(prior))
    return counts.join(F.broadcast(overall)).select(*cells, rate.alias("expected"))


def expected_profile(events: DataFrame, key: str, cells: Sequence[str], hit: str, prior: float = 25.0) -> DataFrame:
    """Per key: tries, hits, difficulty (1 - expected rate) and rate above expected.

    Counts per key and cell are joined to the cells' rates, not events.
    """
    rates = expected_rates(events, cells, hit, prior)
    per_cell = events.groupBy(key, *cells).agg(F.count(hit).alias("_n"), F.sum(hit).alias("_h"))
    out = per_cell.join(rates, list(cells)).groupBy(key).agg(
        F.sum("_n").alias("tries"), F.sum("_h").alias("hits"), (F.sum(F.col("_n") * F.col("expected")) / F.sum("_n")).alias("_expected")
    )
    return out.select(key, "tries", "hits", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_expected"))).alias("difficulty"), (F.col("hits") / F.col("tries") - F.col("_expected")).alias("above_expected"))


def weighted_shares(rows: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], weight: str) -> DataFrame:
    """Share of the weight that each kind has."""
    total = F.sum(weight)
    return rows.groupBy(*keys).agg(total.alias("weight"), *[ratio(F.sum(F.when(F.col(kind) == k, F.col(weight)).otherwise(0.0)), total).alias(f"share_{k}") for k in kinds])


def flag_means(rows: DataFrame, keys: Sequence[str], flags: dict[str, Column], spreads: dict[str, Column]) -> DataFrame:
    """Means of flags and population deviations of measures."""
    return rows.groupBy(*keys).agg(*[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n) for n, c in flags.items()], *[F.stddev_pop(c).alias(n) for n, c in spreads.items()])


def recent_trend(rows: DataFrame, key: str, order: Sequence[Column], measure: str, most: int = 5, least: int = 6, tolerance: float = 0.0) -> DataFrame:
    """Mean of the last w rows against the w before (w: half of the rows, `most` at most), with a direction."""
    n = F.count("*").over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    marked = rows.withColumn("_n", n).withColumn("_p", place).filter(F.col("_n") >= least).withColumn("_w", F.least(F.lit(most), F.floor(F.col("_n") / 2)))
    recent = F.avg(F.when(F.col("_p") <= F.col("_w"), F.col(measure)))
    prior = F.avg(F.when((F.col("_p") > F.col("_w")) & (F.col("_p") <= 2 * F.col("_w")), F.col(measure)))
    out = marked.groupBy(key).agg(recent.alias("recent"), prior.alias("prior")).withColumn("change", F.col("recent") - F.col("prior"))
    way = F.when(F.col("change") > tolerance, "up").when(F.col("change") < -tolerance, "down").otherwise("steady")
    return out.withColumn("direction", way)


def reliability_smooth(rows: DataFrame, group: str, value: str, weight: str, prior: float) -> DataFrame:
    """Values pulled towards their group's weighted mean by `prior` tries."""
    seen = F.when(F.col(value).isNotNull(), F.col(weight))
    means = rows.groupBy(group).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(seen)).alias("_mean"))
    out = rows.join(means, group)
    smooth = (F.col(value) * F.col(weight) + F.lit(prior) * F.col("_mean")) / (F.col(weight) + F.lit(prior))
    return out.withColumn("smoothed", F.coalesce(smooth, "_mean")).drop("_mean")


def pooled(rows: DataFrame, keys: Sequence[str], weight: str, traits: Sequence[str], quality: str) -> DataFrame:
    """A group as one vector: weighted traits and quality, mean quality of the best three, concentration of the weights.

    Missing traits count as 0.5. The best three come from a window limit, so a group is never gathered.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    r = rows.withColumn("_w", w)
    g = Window.partitionBy(*keys)
    r = r.withColumn("_best", F.row_number().over(g.orderBy(F.when(F.col("_w") > 0, 0).otherwise(1), F.coalesce(F.col(quality), F.lit(0.5)).desc())))
    r = r.withColumn("_heavy", F.row_number().over(g.orderBy(F.col("_w").desc())))
    total, q = F.sum("_w"), F.coalesce(F.col(quality), F.lit(0.5))
    return r.groupBy(*keys).agg(
        *[ratio(F.sum(F.col("_w") * F.coalesce(F.col(t), F.lit(0.5))), total).alias(f"roster_{t}") for t in traits],
        ratio(F.sum(F.col("_w") * q), total).alias("rotation_quality"),
        F.avg(F.when((F.col("_best") <= 3) & (F.col("_w") > 0), q)).alias("top_three_quality"),
        ratio(total * total, F.sum(F.col("_w") * F.col("_w"))).alias("effective_size"),
        ratio(F.sum(F.when(F.col("_heavy") <= 3, F.col("_w")).otherwise(0.0)), total).alias("top_three_share"),
    )


def training_rows(stints: DataFrame, vectors: DataFrame, results: DataFrame, player: Sequence[str], team: Sequence[str], weight: str, traits: Sequence[str], quality: str, *, least_games: int = 60) -> DataFrame:
    """A row for each team with results of at least least_games: the pooled vector of its stints, its results, and league_rank by net.

    A player's vector joins many stints, a team's vector one row of results; a key that repeats where it mustn't stops the
    job. No result is among the inputs that are pooled. Players without a vector and teams without results are left out.
    """
    from tallyforge.operators.joins import checked_join

    made = pooled(checked_join(stints, vectors, player), team, weight, traits, quality)
    place = F.row_number().over(Window.partitionBy(team[0]).orderBy(F.desc("net"), *team[1:]))
    ranked = results.withColumn("league_rank", place)
    return checked_join(made, ranked, team, validate="1:1").filter(F.col("games") >= least_games)


def entropy(shares: Sequence[Column]) -> Column:
    """Normalised entropy of shares: 1 when all are equal."""
    import math

    terms = [F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in shares]
    return sum(terms[1:], terms[0]) / F.lit(math.log(len(shares)))
