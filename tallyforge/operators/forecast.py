"""Forecasts of rosters and how good they are: talent, wins, anchoring, held-out errors, paired comparisons, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.ratios import clip
from tallyforge.operators import folds
from tallyforge.operators.roster import fit_minutes
from tallyforge.operators.windows import cumulative, on_group
from tallyforge.sources.scratch import kept

#: Shares of the talent index, and games of a season.
ROTATION, TOP_THREE = 0.65, 0.35
SEASON_GAMES = 82


def talent_index(rotation: Column, top_three: Column) -> Column:
    return F.lit(ROTATION) * rotation + F.lit(TOP_THREE) * top_three


def talent_summary(rosters: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """talent_index of each roster, the percentage of history at or below it, and history's range; a roster without an index has nulls.

    Rosters and history stand on one line on which only history has weight, so the running weight at a roster's value is the history up to it.
    """
    index = talent_index(F.col("rotation_quality"), F.col("top_three_quality"))
    own, past = rosters.select(key, index.alias("talent_index")), history.select(index.alias("t")).filter("t is not null")
    of = past.agg(F.min("t").alias("historical_min"), F.max("t").alias("historical_max"))
    line = own.select(F.col("talent_index").alias("t"), F.lit(0).alias("past")).unionByName(past.withColumn("past", F.lit(1)))
    at = cumulative(line, "t", weight="past").select("v", F.try_divide(100 * F.col("upto"), F.nullif("total", F.lit(0))).alias("historical_percentile"))
    found = own.join(at, F.col("talent_index") == F.col("v"), "left").join(F.broadcast(of))  # a row
    return found.select(key, "talent_index", "historical_percentile", "historical_min", "historical_max")


def wins(net_rating: Column, slope: float | Column, intercept: float | Column) -> Column:
    """Expected wins of a season by a logistic curve of the net rating; within 0 and 82."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.lit(float(SEASON_GAMES)) / (1 + F.exp(-(as_column(slope) * net_rating + as_column(intercept))))


def quality_forecast(rows: DataFrame, net: str, error: float, slope: float, intercept: float) -> DataFrame:
    """rows with the net rating's interval and the wins of its middle and ends."""
    low, high = F.col(net) - F.lit(error), F.col(net) + F.lit(error)
    a, b = wins(low, slope, intercept), wins(high, slope, intercept)
    bound = lambda x: clip(x, 0.0, float(SEASON_GAMES))
    return rows.withColumns({"net_rating_low": low, "net_rating_high": high, "expected_wins": bound(wins(F.col(net), slope, intercept)), "wins_low": bound(F.least(a, b)), "wins_high": bound(F.greatest(a, b))})


def ceiling_forecast(rows: DataFrame, line: tuple[float, float], slope: float, intercept: float) -> DataFrame:
    """rows with the optimistic net rating of their talent (slope and intercept of a non-negative line) and its wins, whole ones half to even."""
    net = talent_index(F.col("rotation_quality"), F.col("top_three_quality")) * F.lit(line[0]) + F.lit(line[1])
    out = rows.withColumn("ceiling_net_rating", net)
    expected = clip(wins(F.col("ceiling_net_rating"), slope, intercept), 0.0, float(SEASON_GAMES))
    return out.withColumn("ceiling_wins", expected).withColumn("display_wins", F.bround(expected).cast("int"))


def anchored(rows: DataFrame, error: float, slope: float, intercept: float) -> DataFrame:
    """Forecasts of an edited roster anchored to what its team did: observed values plus the model's change.

    rows has net_rating and expected_wins of the edited roster, base_net_rating and base_expected_wins of the model for the team
    as it is, observed_net_rating, observed_wins and observed_games. A team without games has null wins.
    """
    c = F.col
    delta = c("net_rating") - c("base_net_rating")
    net = c("observed_net_rating") + delta
    pace = F.try_divide(F.lit(float(SEASON_GAMES)) * c("observed_wins"), F.nullif(c("observed_games"), F.lit(0)))
    expected = pace + c("expected_wins") - c("base_expected_wins")
    spread = F.abs(wins(net + F.lit(error), slope, intercept) - wins(net, slope, intercept))
    bound = lambda x: clip(x, 0.0, float(SEASON_GAMES))
    return rows.select("*", net.alias("anchored_net_rating"), (net - F.lit(error)).alias("anchored_low"), (net + F.lit(error)).alias("anchored_high"), bound(expected).alias("anchored_wins"), bound(expected - spread).alias("anchored_wins_low"), bound(expected + spread).alias("anchored_wins_high"), delta.alias("model_delta"))


def trait_changes(baseline: DataFrame, simulated: DataFrame, key: str, traits: Sequence[str]) -> DataFrame:
    """Each trait of both rosters of a key and its change, with its place by size of change."""
    long = lambda df, name: df.unpivot([key], list(traits), "trait", name)
    both = long(baseline, "baseline").join(long(simulated, "simulated"), [key, "trait"]).withColumn("change", F.col("simulated") - F.col("baseline"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs(F.col("change"))), "trait")))


def simulated_roster(pool: DataFrame, picks: DataFrame, roster: str, *, total: float = 240.0, cap: float = 48.0) -> DataFrame:
    """Rosters of picks (roster, player_id, override minutes or null) with minutes that sum to `total`.

    A player picked twice counts once (the first override by value). An unknown player or a roster without weight is an error.
    """
    once = picks.groupBy(roster, "player_id").agg(F.min("override").alias("override"))
    rows = once.join(pool.select("player_id", "minutes_per_game", F.lit(True).alias("_known")), "player_id", "left")
    weight = F.when(F.col("_known").isNull(), F.raise_error(F.lit("a roster has a player that the pool has not"))).otherwise(F.greatest(F.lit(0.0), F.coalesce("override", "minutes_per_game")))
    rows = rows.withColumn("rotation_weight", weight.cast("double"))
    some = F.sum("rotation_weight").over(Window.partitionBy(roster))
    rows = rows.withColumn("rotation_weight", F.when(some > 0, F.col("rotation_weight")).otherwise(F.raise_error(F.lit("a roster has no minutes to share")).cast("double")))
    out = fit_minutes(rows.drop("_known"), roster, "rotation_weight", "normalized_minutes", total, cap)
    return out.withColumn("rotation_share", F.col("normalized_minutes") / F.lit(total))


def left_out_lines(rows: DataFrame, season: str, x: str, y: str) -> DataFrame:
    """rows with the prediction of a line fitted on all other seasons: sums of all less those of the own season, in one pass."""
    sums = {"n": F.count("*"), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(F.col(x) * F.col(x)), "xy": F.sum(F.col(x) * F.col(y))}
    own = rows.groupBy(season).agg(*[f.alias(f"_o{k}") for k, f in sums.items()])
    total = rows.agg(*[f.alias(f"_t{k}") for k, f in sums.items()])
    both = own.join(F.broadcast(total)).withColumns({f"_{k}": F.col(f"_t{k}") - F.col(f"_o{k}") for k in sums})
    slope = F.try_divide(F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y"), F.nullif(F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x"), F.lit(0.0)))
    both = both.withColumn("_s", slope).withColumn("_i", (F.col("_y") - F.col("_s") * F.col("_x")) / F.col("_n")).select(season, "_s", "_i")
    return on_group(rows, both, [season]).withColumn("predicted", F.col("_s") * F.col(x) + F.col("_i")).drop("_s", "_i")


def calibrator_errors(rows: DataFrame, season: str, net: str, won: str, games: str) -> DataFrame:
    """Mean absolute error of wins a season, by left-out seasons: of the logistic curve and of a line.

    The curves of all left-out seasons are fitted together (folds.win_curves).
    """
    data = rows.select(F.col(season).alias("season"), F.col(net).cast("double").alias("x"), F.col(won).cast("double").alias("w"), F.col(games).cast("double").alias("g"))
    data = kept(folds.left_out(data, "season").withColumn("y", F.lit(float(SEASON_GAMES)) * F.col("w") / F.col("g")), "fold-rows")
    curves = folds.apply_lines(data, folds.win_curves(data, "x", "w", "g"), ["x"], "bounded", chance=True).withColumn("predicted", F.lit(float(SEASON_GAMES)) * F.col("predicted"))
    found = folds.moments(data, ["x"], "y")
    lines = folds.apply_lines(data, {f: m.line(folds.ridge(m, 0.0)) for f, m in found.items()}, ["x"], "linear")
    error = F.abs(F.col("predicted") - F.col("y"))
    of = lambda name: F.avg(F.when(F.col("model") == name, error)).alias(f"{name}_mae")
    return curves.unionByName(lines).agg(of("bounded"), of("linear"))


def held_out_errors(rows: DataFrame, target: str, actual: str, predicted: str, baseline: str) -> DataFrame:
    """Per target: rows, MAE, MAE in population deviations, R2, the baseline's MAE and whether it is beaten."""
    a, p = F.col(actual), F.col(predicted)
    out = rows.groupBy(target).agg(F.count("*").alias("rows"), F.avg(F.abs(a - p)).alias("mae"), F.stddev_pop(a).alias("_s"), F.avg((a - p) * (a - p)).alias("_e"), F.avg(F.abs(a - F.col(baseline))).alias("baseline_mae"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return out.select(target, "rows", "mae", (F.col("mae") / scale).alias("normalized_mae"), F.when(F.col("_s") > 0, 1 - F.col("_e") / (F.col("_s") * F.col("_s"))).alias("r2"), "baseline_mae", (F.col("mae") < F.col("baseline_mae")).alias("beats_baseline"))


def fold_summary(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means and deviations of metrics over the folds or seeds of each kind, and how many there were."""
    return rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], *[F.stddev_samp(m).alias(f"{m}_deviation") for m in metrics], F.count("*").alias("folds"))


def paired_folds(rows: DataFrame, model: str, new: str, old: str, metric: str, keys: Sequence[str] = ("seed", "fold")) -> DataFrame:
    """Mean difference of a metric between two models for each fold, over seeds."""
    value = lambda m: F.max(F.when(F.col(model) == m, F.col(metric)))
    pairs = rows.groupBy(*keys).agg((value(new) - value(old)).alias("delta")).filter("delta is not null")
    return pairs.groupBy(keys[-1]).agg(F.avg("delta").alias("delta"))


def paired_evidence(deltas: DataFrame, fold: str, *, draws: int = 20_000, seed: int = 42) -> DataFrame:
    """Mean, wins, ties and losses of fold differences, and the 95 % interval of the mean of resampled folds.

    A draw takes a fold for each place by a hash, so reruns agree; draws are rows, not loops.
    """
    from tallyforge.operators.windows import exact_quantiles

    d = F.col("delta")
    counts = deltas.agg(F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"))
    folds = deltas.select(F.array_sort(F.collect_list(F.struct(fold, "delta")).over(Window.partitionBy(F.lit(0)))).alias("f")).limit(1)  # folds are a few dozen
    drawn = deltas.sparkSession.range(draws).join(F.broadcast(folds))
    pick = F.transform(F.sequence(F.lit(1), F.size("f")), lambda i: F.get("f", F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.size("f")).cast("int"))["delta"])
    means = drawn.select((F.aggregate(pick, F.lit(0.0), lambda s, x: s + x) / F.size("f")).alias("m"))
    at = exact_quantiles(means, "m", [0.025, 0.975]).withColumnsRenamed({"q0": "low", "q1": "high"})
    return counts.join(F.broadcast(at))  # a row each


def gate(rows: DataFrame, keys: Sequence[str], value: str, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Whether the mean of a metric holds a stored baseline: mean >= baseline - tolerance; an unknown baseline is null."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return means.join(baseline.withColumnRenamed(value, "baseline"), list(keys), "left").withColumn("passed", F.col("mean") >= F.col("baseline") - F.lit(tolerance))


def permuted_labels(rows: DataFrame, key: str, label: str, times: int, seed: int = 3) -> DataFrame:
    """rows `times` over with the labels dealt anew among all keys by hash order: permutation, key, label.

    Two range orders of the same rows are zipped by place; places come from running counts, so no task sorts all rows. Keys
    are unique; those of one hash follow each other by key, so every label is dealt once.
    """
    many = kept(rows.select(key, label, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("permutation")), "permutations")
    mark = lambda salt: (F.xxhash64(F.lit(seed + salt), F.col("permutation"), F.col(key)) / F.lit(float(1 << 63))).alias("h")

    def placed(salt: int, column: str) -> DataFrame:
        marked = many.select("permutation", F.col(key).alias("_key"), F.col(column).alias(column), mark(salt))
        order = cumulative(marked, "h", ["permutation"]).select("permutation", F.col("v").alias("h"), (F.col("upto") - F.col("n")).alias("before"))
        nr = F.row_number().over(Window.partitionBy("permutation", "h").orderBy("_key"))  # nearly always one row
        return marked.join(order, ["permutation", "h"]).select("permutation", (F.col("before") + nr).alias("place"), column)

    return placed(0, key).join(placed(1, label), ["permutation", "place"]).drop("place")


def group_weights(budgets: dict[str, float], members: dict[str, Sequence[str]]) -> dict[str, float]:
    """Weight of each feature such that its group has its budget of the squared distance; their mean is 1."""
    if set(budgets) != set(members) or abs(sum(budgets.values()) - 1) > 1e-8:
        raise ValueError("budgets must cover every group and sum to one")
    raw = {f: (budgets[g] / len(fs)) ** 0.5 for g, fs in members.items() for f in fs}
    mean = sum(raw.values()) / len(raw)
    return {f: w / mean for f, w in raw.items()}


def group_shares(rows: DataFrame, keys: Sequence[str], weights: dict[str, float], members: dict[str, Sequence[str]]) -> DataFrame:
    """For each row the weighted squared distance from the mean row, and the share of it that each group of features makes.

    Features are standardised over all rows (population deviation; one that doesn't vary counts 0; null is the mean).
    """
    names = [f for fs in members.values() for f in fs]
    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in names], *[F.stddev_pop(f).alias(f"s_{f}") for f in names])
    z = lambda f: F.coalesce(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.nullif(F.col(f"s_{f}"), F.lit(0.0))), F.lit(0.0))
    parts = {g: sum((F.lit(weights[f] ** 2) * z(f) * z(f) for f in fs), F.lit(0.0)) for g, fs in members.items()}
    out = rows.join(F.broadcast(stats)).select(*keys, *[p.alias(f"_{g}") for g, p in parts.items()])  # a row of statistics
    total = sum((F.col(f"_{g}") for g in parts), F.lit(0.0))
    return out.select(*keys, total.alias("distance"), *[F.try_divide(F.col(f"_{g}"), F.nullif(total, F.lit(0.0))).alias(f"{g}_share") for g in parts])


def half_reliability(games: Column, minutes: Column, shots: Column, half: bool = False) -> Column:
    """Reliability of a (half) season within 0.05 and 1."""
    k = 0.5 if half else 1.0
    return clip(F.least(games / F.lit(50 * k), minutes / F.lit(1500 * k), shots / F.lit(500 * k)), 0.05, 1.0)


def enough(rows: DataFrame, half: bool = False) -> DataFrame:
    """Rows with the least games, minutes and shots of a (half) season."""
    k = 0.5 if half else 1.0
    return rows.filter((F.col("games_played") >= 20 * k) & (F.col("minutes_total") >= 500 * k) & (F.col("shot_attempts") >= 100 * k))


def both_views(profiles: DataFrame, keys: Sequence[str], view: str = "view") -> DataFrame:
    """Profiles of the keys that have both views."""
    full = profiles.groupBy(*keys).agg(F.countDistinct(view).alias("_v")).filter("_v = 2").drop("_v")
    return profiles.join(full, list(keys), "left_semi")
