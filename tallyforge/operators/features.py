"""Features of player seasons and team seasons: rates, joined profiles, eligibility, reliability, traits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.functions.ratios import clip, finite, logistic, per_minutes, possessions, ratio, shrink, used_chances
from tallyforge.operators.windows import exact_quantiles, on_group, percentiles, pick
from tallyforge.sources.scratch import kept

#: Totals of which there are rates per 36 minutes.
PER_36 = ["field_goal_attempts", "assists", "turnovers", "offensive_rebounds", "defensive_rebounds", "steals", "blocks"]
#: Least games, minutes, shots, possessions defended, tries defended and logged actions.
FLOORS = {"games": 20, "minutes": 500, "shots": 100, "possessions": 300, "defended": 75, "actions": 100}
#: How much of each makes a season fully reliable.
FULL = {"games": 50, "minutes": 1500, "shots": 500, "possessions": 2000, "defended": 400, "actions": 500}


def one_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row for each value of keys: the first by order (and then by all other columns, so reruns agree)."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return pick(df, keys, [*order, *rest])


def season_rates(seasons: DataFrame) -> DataFrame:
    """Rates of a player season from its totals; minutes_total from games and minutes a game. A rate without a base is null."""
    c = F.col
    out = seasons.withColumn("minutes_total", finite(c("games_played")) * finite(c("minutes_per_game")))
    used = used_chances(c("field_goal_attempts_total"), c("free_throw_attempts_total"), c("turnovers_total"))
    return out.withColumns({
        **{f"{x}_per_36": per_minutes(c(f"{x}_total"), c("minutes_total")) for x in PER_36},
        "three_point_attempt_rate": ratio(c("three_point_attempts_total"), c("field_goal_attempts_total")),
        "free_throw_attempt_rate": ratio(c("free_throw_attempts_total"), c("field_goal_attempts_total")),
        "assist_turnover_ratio": ratio(c("assists_total"), c("turnovers_total")),
        "used_per_36": per_minutes(used, c("minutes_total")),
    })


def with_biography(rows: DataFrame, people: DataFrame, known: dict[int, str] | None = None) -> DataFrame:
    """Adds position, height, weight and age on 1 February of the season; `known` positions go before the flags."""
    out = rows.join(one_each(people.select("player_id", "guard", "forward", "center", "height", "weight", "birth"), ["player_id"]), "player_id", "left")
    place = labels.position(F.col("guard"), F.col("forward"), F.col("center"))
    if known:
        place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("player_id")), place)
    day = F.make_date(labels.season_start(F.col("season")) + 1, F.lit(2), F.lit(1))
    return out.withColumn("position", place).withColumn("age", labels.age_on(F.col("birth"), day)).drop("guard", "forward", "center", "birth")


def judged(rows: DataFrame, floors: dict[str, float] = FLOORS, full: dict[str, float] = FULL) -> DataFrame:
    """Eligibility by floors and reliability (0 to 1: the least share of what is full) of each kind; null amounts are 0."""
    names = {"games": "games_played", "minutes": "minutes_total", "shots": "shot_attempts", "possessions": "matchup_possessions", "defended": "matchup_tries", "actions": "action_shots"}
    have = {k: F.coalesce(finite(F.col(c)) if c in rows.columns else F.lit(None).cast("double"), F.lit(0.0)) for k, c in names.items()}
    enough = lambda *ks: reduce(lambda a, b: a & b, [have[k] >= F.lit(floors[k]) for k in ks])
    share = lambda *ks: clip(reduce(F.least, [have[k] / F.lit(full[k]) for k in ks]))
    offence, defence = enough("games", "minutes", "shots"), enough("games", "minutes", "possessions", "defended")
    sure, sure_defence = share("games", "minutes", "shots"), share("games", "minutes", "possessions", "defended")
    modern = F.least(sure, share("actions"))
    return rows.withColumns({
        "offensive_eligible": offence, "defensive_eligible": defence, "overall_eligible": offence & defence,
        "modern_offensive_eligible": offence & enough("actions"), "modern_defensive_eligible": defence & enough("actions"),
        "modern_overall_eligible": offence & defence & enough("actions"),
        "offensive_reliability": sure, "defensive_reliability": sure_defence, "overall_reliability": F.least(sure, sure_defence),
        "modern_offensive_reliability": modern, "modern_overall_reliability": F.least(modern, sure_defence),
    })


def style_features(seasons: DataFrame, shots: DataFrame, people: DataFrame, *, more: Sequence[DataFrame] = (), impact: DataFrame | None = None,
                   floors: dict[str, float] = FLOORS, known: dict[int, str] | None = None) -> DataFrame:
    """A row for each player season: rates, shot profile, biography, further profiles by (player_id, season), impact, eligibility.

    Each table is reduced to a row a key before its join, so no join multiplies rows; lacking facts are null.
    """
    keys = ["player_id", "season"]
    out = season_rates(seasons).join(one_each(shots, keys), keys, "left")
    out = with_biography(out, people, known)
    for df in more:
        out = out.join(one_each(df, keys), keys, "left")
    if impact is not None:
        out = out.join(one_each(impact.select(*keys, "dpm", "o_dpm", "d_dpm"), keys), keys, "left")
    return judged(out, floors)


def live_features(feed: DataFrame, shots: DataFrame, people: DataFrame, season: str, least_games: int = 3, least_shots: int = 15) -> DataFrame:
    """style_features() of a season under way: low floors, defaults for players without a biography, reliability
    by 20 games and 400 shots, no impact."""
    padded = feed.select("player_id").distinct().join(people, "player_id", "left").fillna(0, ["guard", "forward", "center"])
    floors = {**FLOORS, "games": least_games, "minutes": 0, "shots": least_shots}
    out = style_features(feed.withColumn("season", F.lit(season)), shots, padded, floors=floors)
    sure = clip(F.least(F.col("games_played") / F.lit(20.0), F.coalesce("shot_attempts", F.lit(0)) / F.lit(400.0)))
    return out.withColumn("offensive_reliability", sure).withColumns({c: F.lit(None).cast("double") for c in ("dpm", "o_dpm", "d_dpm")})


#: Rows of which a task tells the different ones apart, about.
DISTINCT_ROWS = 500_000


def _distinct_games(rows: DataFrame) -> DataFrame:
    """player_id, season and matchup_games, how many different game_id they have, for rows of these three.

    They are told apart in as many parts as the rows need: sums beside a distinct count are kept for each game, in a task's memory, and
    games grow with the input.
    """
    rows = kept(rows, "matchup-games")
    each = rows.repartition(max(1, -(-rows.count() // DISTINCT_ROWS)), *rows.columns).distinct()
    return each.groupBy("player_id", "season").agg(F.count("game_id").alias("matchup_games"))


def matchup_profiles(matchups: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Per defender and season: whom they guarded (shares of possessions by position, mean height) and what came of it."""
    c = F.col
    rows = matchups.filter(c("_season_type") == "rg").withColumn("season", labels.season_label(c("_season")))
    place = F.upper("position")
    if people is not None:
        flags = F.when(c("guard") == 1, "G").when(c("center") == 1, "C").when(c("forward") == 1, "F").otherwise("other")
        facts = one_each(people.select(c("player_id").alias("person_id"), flags.alias("_place"), "height"), ["person_id"])
        rows = rows.join(facts, "person_id", "left")
        place = F.coalesce(place, "_place")
    else:
        rows = rows.withColumn("height", F.lit(None).cast("double"))
    place = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(place, F.lit("")), "([GFC])", 1), F.lit("")), F.lit("other"))
    weight = F.coalesce(finite(c("partial_possessions")), F.lit(0.0))
    rows = rows.withColumn("_p", place).withColumn("_w", weight)
    sums = {"matchup_possessions": "partial_possessions", "matchup_tries": "matchup_field_goals_attempted", "matchup_threes": "matchup_three_pointers_attempted", "matchup_turnovers": "matchup_turnovers", "matchup_blocks": "matchup_blocks", "matchup_fouls": "shooting_fouls"}
    games = _distinct_games(matchups.filter(c("_season_type") == "rg").select(c("matchups_person_id").alias("player_id"), labels.season_label(c("_season")).alias("season"), "game_id"))
    out = rows.groupBy(c("matchups_person_id").alias("player_id"), "season").agg(
        *[F.sum(source).alias(name) for name, source in sums.items()],
        *[F.sum(F.when(c("_p") == k, c("_w")).otherwise(0.0)).alias(f"_{k}") for k in "GFC"],
        F.sum(c("height") * c("_w")).alias("_h"),
    )
    out = on_group(out, games, ["player_id", "season"])
    return out.withColumns({
        **{f"matchup_{name}_share": ratio(c(f"_{k}"), c("matchup_possessions"), 0.0) for k, name in (("G", "guard"), ("F", "forward"), ("C", "center"))},
        "matchup_try_rate": ratio(c("matchup_tries"), c("matchup_possessions")),
        "matchup_three_rate": ratio(c("matchup_threes"), c("matchup_tries")),
        "matchup_turnover_rate": ratio(c("matchup_turnovers"), c("matchup_possessions")),
        "matchup_block_rate": ratio(c("matchup_blocks"), c("matchup_tries")),
        "matchup_foul_rate": ratio(c("matchup_fouls"), c("matchup_possessions")),
        "matchup_height": ratio(c("_h"), c("matchup_possessions")),
    }).drop("_G", "_F", "_C", "_h")


#: The zones of which mixes are made.
ZONES = ["rim", "paint", "midrange", "three_point"]


def shot_context(shots: DataFrame, keys: Sequence[str] = ("player_id", "season"), least: int = 40, least_regular: int = 100, least_playoff: int = 30) -> DataFrame:
    """How a player's zones change between home and away, first half and fourth quarter, regular season and playoffs.

    shots has zone, home (boolean), period and season_type ('rg' or 'po'). One pass of conditional counts; a shift is null unless both
    of its sides have enough shots. Only players with regular shots have a row.
    """
    regular = F.col("season_type") == "rg"
    sides = {
        "home": regular & F.coalesce(F.col("home"), F.lit(False)), "away": regular & ~F.coalesce(F.col("home"), F.lit(False)),
        "first": regular & (F.col("period") <= 2), "fourth": regular & (F.col("period") == 4), "regular": regular, "playoff": F.col("season_type") == "po",
    }
    n = {s: F.count_if(F.coalesce(x, F.lit(False))).alias(s) for s, x in sides.items()}
    zone = {f"{s}_{z}": F.count_if(F.coalesce(x, F.lit(False)) & (F.col("zone") == z)).alias(f"{s}_{z}") for s, x in sides.items() for z in ZONES}
    out = shots.groupBy(*keys).agg(*n.values(), *zone.values()).filter("regular > 0")
    share = lambda s, z: ratio(F.col(f"{s}_{z}"), F.col(s))

    def shift(a: str, b: str) -> Column:
        return reduce(lambda x, y: x + y, [F.abs(share(a, z) - share(b, z)) for z in ZONES])

    both, quarter = (F.least("home", "away") >= least), (F.least("first", "fourth") >= least)
    post = (F.col("regular") >= least_regular) & (F.col("playoff") >= least_playoff)
    return out.select(
        *keys, F.col("regular").alias("regular_season_shots"), ratio(F.col("home"), F.col("regular")).alias("home_shot_frequency"),
        *[share(s, z).alias(f"{s}_{z}_frequency") for s in ("home", "away", "first", "fourth") for z in ZONES],
        both.alias("home_away_eligible"), quarter.alias("quarter_eligible"), post.alias("playoff_eligible"), F.nullif(F.col("playoff"), F.lit(0)).alias("playoff_shots"),
        F.when(both, shift("home", "away")).alias("home_away_shift"), F.when(quarter, shift("first", "fourth")).alias("quarter_shift"), F.when(post, shift("regular", "playoff")).alias("playoff_shift"),
    )


#: Distance classes in feet, and how far from the middle a side begins.
DISTANCES = {"0_3": (None, 3), "4_7": (4, 7), "8_15": (8, 15), "16_22": (16, 22), "23_27": (23, 27), "28_39": (28, 39), "40_plus": (40, None)}
SIDE = 80


def location_profiles(shots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means of 14 location flags of shots and two spreads.

    shots has shot_distance, shot_zone_basic, shot_zone_area, shot_type and loc_x. A shot without loc_x has no side.
    """
    far = F.greatest(F.coalesce(finite(F.col("shot_distance")), F.lit(0.0)), F.lit(0.0))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    has = lambda c, t: F.contains(low(c), F.lit(t))
    three = has("shot_type", "3pt") | has("shot_zone_basic", "3")
    corner = three & (has("shot_zone_basic", "corner") | low("shot_zone_area").isin("left side(l)", "right side(r)"))
    x = finite(F.col("loc_x"))
    within = lambda lo, hi: far <= hi if lo is None else far >= lo if hi is None else far.between(lo, hi)
    flags = {f"distance_{k}_frequency": within(lo, hi) for k, (lo, hi) in DISTANCES.items()} | {
        "restricted_frequency": has("shot_zone_basic", "restricted"),
        "other_paint_frequency": has("shot_zone_basic", "paint") & ~has("shot_zone_basic", "restricted"),
        "corner_three_frequency": corner,
        "above_break_three_frequency": three & ~corner & ~has("shot_zone_area", "back"),
    }
    mean = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    side = {"left_side_frequency": x < -SIDE, "center_frequency": F.abs(x) <= SIDE, "right_side_frequency": x > SIDE}
    return shots.groupBy(*keys).agg(
        *[mean(c).alias(n) for n, c in flags.items()], *[F.avg(F.when(x.isNotNull(), F.when(c, 1.0).otherwise(0.0))).alias(n) for n, c in side.items()],
        F.stddev_pop(far).alias("distance_spread"), (F.stddev_pop(x) / 250).alias("lateral_spread"),
    )


#: Counts of a team's game, and the features of a team season in the order of their use.
TEAM_COUNTS = ["team_score", "field_goals_attempted", "field_goals_made", "three_pointers_attempted", "three_pointers_made", "free_throws_attempted", "free_throws_made", "rebounds_offensive",
               "rebounds_defensive", "turnovers", "assists", "steals", "blocks", "points_in_the_paint", "points_fast_break", "points_second_chance", "bench_points"]
TEAM_FEATURES = ["effective_field_goal_percentage", "opponent_effective_field_goal_percentage", "turnover_percentage", "forced_turnover_percentage", "offensive_rebound_percentage",
                 "defensive_rebound_percentage", "free_throw_rate", "three_point_attempt_rate", "assist_ratio", "pace", "stocks_per_100", "paint_scoring_share", "fast_break_scoring_share",
                 "second_chance_scoring_share", "bench_scoring_share"]


def team_seasons(games: DataFrame) -> DataFrame:
    """Possession-adjusted features of each team season, wins and rank in the league (ties by team_id, team).

    games has a row for each team of a game. Rows without a team are left out; a game without its other side counts
    for the team alone. Totals of both sides come from one join and one aggregation.
    """
    rows = games.filter((F.coalesce("team_id", F.lit(0)) > 0) & (F.trim(F.coalesce("team", F.lit(""))) != ""))
    other = rows.select("season", "game_id", F.col("team_id").alias("opponent_team_id"), *[F.col(c).alias(f"o_{c}") for c in TEAM_COUNTS])
    both = rows.join(other, ["season", "game_id", "opponent_team_id"], "left")
    won = F.col("team_score") > F.col("opponent_score")
    t = both.groupBy("season", "team_id", "team").agg(
        F.countDistinct("game_id").alias("games"), F.count_if(won).alias("wins"), F.avg(F.when(won, 1.0).otherwise(0.0)).alias("win_percentage"),
        *[F.sum(c).alias(c) for c in TEAM_COUNTS], *[F.sum(f"o_{c}").alias(f"o_{c}") for c in TEAM_COUNTS],
    )
    c = F.col
    own = possessions(c("field_goals_attempted"), c("rebounds_offensive"), c("turnovers"), c("free_throws_attempted"))
    opp = possessions(c("o_field_goals_attempted"), c("o_rebounds_offensive"), c("o_turnovers"), c("o_free_throws_attempted"))
    t = t.withColumn("_own", own).withColumn("_opp", opp)
    effective = lambda p: ratio(c(f"{p}field_goals_made") + 0.5 * c(f"{p}three_pointers_made"), c(f"{p}field_goals_attempted"))
    features = [
        effective(""), effective("o_"), ratio(c("turnovers"), c("_own")), ratio(c("o_turnovers"), c("_opp")),
        ratio(c("rebounds_offensive"), c("rebounds_offensive") + c("o_rebounds_defensive")), ratio(c("rebounds_defensive"), c("rebounds_defensive") + c("o_rebounds_offensive")),
        ratio(c("free_throws_made"), c("field_goals_attempted")), ratio(c("three_pointers_attempted"), c("field_goals_attempted")), ratio(c("assists"), c("field_goals_made")),
        ratio(c("_own") + c("_opp"), 2 * c("games")), 100 * ratio(c("steals") + c("blocks"), c("_own")),
        *[ratio(c(x), c("team_score")) for x in ("points_in_the_paint", "points_fast_break", "points_second_chance", "bench_points")],
    ]
    out = t.select("season", "team_id", "team", "games", "wins", "win_percentage", (100 * ratio(c("team_score"), c("_own"))).alias("offensive_rating"), (100 * ratio(c("o_team_score"), c("_opp"))).alias("defensive_rating"), *[x.alias(n) for n, x in zip(TEAM_FEATURES, features, strict=True)])
    out = out.withColumn("net_rating", c("offensive_rating") - c("defensive_rating"))
    return pick(out, ["season"], [F.desc("win_percentage"), c("team_id"), c("team")], 1 << 30, "league_rank")  # teams of a season


def _blend(*parts: tuple[float, str]) -> Column:
    return clip(reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"pct_{c}") for w, c in parts]))


#: What each trait of a candidate is blended from (share, measure); a measure in LOW is better when small.
LOW = {"turnovers_per_game", "turnovers_per_36"}
CANDIDATE_TRAITS = {
    "shooting_efficiency": [(0.75, "effective_field_goal_percentage"), (0.25, "points_per_game")],
    "defensive_activity": [(0.50, "stocks_per_game"), (0.25, "steals_per_game"), (0.25, "defensive_rebounds_per_game")],
    "decision_making": [(0.55, "assist_turnover_ratio"), (0.30, "assists_per_game"), (0.15, "turnovers_per_game")],
    "turnover_creation": [(1.0, "steals_per_game")],
    "offensive_rebounding": [(1.0, "offensive_rebounds_per_game")],
    "defensive_rebounding": [(1.0, "defensive_rebounds_per_game")],
    "rim_pressure": [(0.5, "free_throw_attempts_per_game"), (0.5, "interior_frequency")],
    "perimeter_spacing": [(1 / 3, "three_point_attempts_per_game"), (1 / 3, "three_point_frequency"), (1 / 3, "three_point_percentage")],
    "playmaking": [(0.5, "assists_per_game"), (0.5, "assist_turnover_ratio")],
    "transition_play": [(0.5, "steals_per_game"), (0.5, "interior_frequency")],
    "interior_scoring": [(1 / 3, "interior_frequency"), (1 / 3, "finishing_frequency"), (1 / 3, "two_point_percentage")],
    "scoring_punch": [(0.5, "points_per_game"), (0.5, "effective_field_goal_percentage")],
}
VECTOR_TRAITS = {
    "scoring_volume": [(1.0, "points_per_36")],
    "scoring_efficiency": [(0.8, "shrunk_efg"), (0.2, "shot_making_above_expected")],
    "perimeter_volume": [(0.7, "three_point_attempts_per_36"), (0.3, "three_point_frequency")],
    "perimeter_accuracy": [(1.0, "shrunk_three_point_percentage")],
    "rim_pressure": [(0.55, "free_throw_attempts_per_36"), (0.45, "rim_frequency")],
    "shot_creation": [(0.55, "field_goal_attempts_per_36"), (0.45, "creation_mix")],
    "playmaking": [(0.65, "assists_per_36"), (0.35, "assist_turnover_ratio")],
    "ball_security": [(0.55, "assist_turnover_ratio"), (0.45, "turnovers_per_36")],
    "offensive_rebounding": [(1.0, "offensive_rebounds_per_36")],
    "defensive_rebounding": [(1.0, "defensive_rebounds_per_36")],
    "disruption": [(1.0, "steals_per_36")],
    "rim_protection": [(1.0, "blocks_per_36")],
    "interior_scoring": [(0.55, "interior_mix"), (0.45, "two_point_percentage")],
}
QUALITY = {"scoring_volume": 0.16, "scoring_efficiency": 0.17, "playmaking": 0.13, "ball_security": 0.10, "perimeter_accuracy": 0.10, "defensive_rebounding": 0.09, "disruption": 0.12, "rim_protection": 0.13}
SHOT_MIX = ["rim_frequency", "paint_frequency", "midrange_frequency", "three_point_frequency", "dunk_frequency", "layup_frequency", "floater_frequency", "pull_up_frequency", "step_back_frequency", "shot_making_above_expected"]


def with_traits(rows: DataFrame, key: Sequence[str], traits: dict[str, list[tuple[float, str]]], group: Sequence[str] = ()) -> DataFrame:
    """rows with trait_<name>, blends of percentiles (in the group) of the measures that rows has; a lacking one counts as 0.5."""
    measures = list(dict.fromkeys(m for parts in traits.values() for _, m in parts))
    lacking = [m for m in measures if m not in rows.columns]
    have = {m: m not in LOW for m in measures if m not in lacking}
    out = percentiles(rows, key, have, group).withColumns({f"pct_{m}": F.lit(0.5) for m in lacking})
    return out.withColumns({f"trait_{name}": _blend(*parts) for name, parts in traits.items()}).drop(*[f"pct_{m}" for m in measures])


def candidate_traits(players: DataFrame) -> DataFrame:
    """Twelve traits of candidates (one row a player_id) on a scale of league percentiles."""
    def some(*names: str) -> Column:
        have = [F.col(n) for n in names if n in players.columns]
        if not have:
            return F.lit(None).cast("double")
        return F.when(reduce(lambda a, b: a & b, [h.isNull() for h in have]), None).otherwise(reduce(lambda a, b: a + b, [F.coalesce(h, F.lit(0.0)) for h in have]))

    c = F.col
    rows = players.withColumns({
        "assist_turnover_ratio": F.when(c("turnovers_per_game") > 0, ratio(c("assists_per_game"), c("turnovers_per_game"))).otherwise(0.0),
        "stocks_per_game": c("steals_per_game") + c("blocks_per_game"),
        "interior_frequency": some("rim_frequency", "paint_frequency"),
        "finishing_frequency": some("dunk_frequency", "layup_frequency", "floater_frequency"),
    })
    return with_traits(rows, ["player_id"], CANDIDATE_TRAITS)


def player_vectors(seasons: DataFrame, shots: DataFrame | None = None, people: DataFrame | None = None, impact: DataFrame | None = None) -> DataFrame:
    """Thirteen traits of player seasons as percentiles within the season, and a quality between 0 and 1.

    Shooting rates are pulled towards the season's mean; shot mixes that a season lacks get its median. The quality is a blend of
    traits, role and plus-minus; where an impact rating exists, its logistic squash instead.
    """
    c, keys = F.col, ["season", "player_id"]
    out = seasons if "minutes_total" in seasons.columns else seasons.withColumn("minutes_total", c("games_played") * c("minutes_per_game"))
    totals = ["points", "field_goal_attempts", "three_point_attempts", "free_throw_attempts", "assists", "turnovers", "offensive_rebounds", "defensive_rebounds", "steals", "blocks"]
    out = out.withColumns({f"{t}_per_36": per_minutes(c(f"{t}_total"), c("minutes_total")) for t in totals})
    out = out.withColumn("assist_turnover_ratio", F.coalesce(ratio(c("assists_total"), c("turnovers_total")), F.least(c("assists_total"), F.lit(10.0))))
    if shots is not None:
        out = out.join(one_each(shots.select(*keys, *[x for x in ("shot_attempts", *SHOT_MIX) if x in shots.columns]), keys), keys, "left")
    out = out.withColumns({x: F.lit(None).cast("double") for x in ("shot_attempts", *SHOT_MIX) if x not in out.columns})
    out = kept(out, "player-seasons")
    long = out.unpivot(["season"], SHOT_MIX, "feature", "x")
    medians = exact_quantiles(long, "x", [0.5], ["season", "feature"]).groupBy("season").agg(*[F.max(F.when(c("feature") == x, c("q0"))).alias(f"_m_{x}") for x in SHOT_MIX])
    means = out.groupBy("season").agg(F.avg("effective_field_goal_percentage").alias("_efg"), F.avg("three_point_percentage").alias("_three"))
    out = out.join(medians, "season", "left")
    out = on_group(out, means, ["season"])
    out = out.withColumns({x: F.coalesce(c(x).cast("double"), c(f"_m_{x}"), F.lit(0.0)) for x in SHOT_MIX})
    shrunk = lambda value, tries, mean, k: shrink(F.coalesce(c(value), c(mean)), F.coalesce(finite(c(tries)), F.lit(0.0)), c(mean), k)
    out = out.withColumns({
        "shrunk_efg": shrunk("effective_field_goal_percentage", "field_goal_attempts_total", "_efg", 150),
        "shrunk_three_point_percentage": shrunk("three_point_percentage", "three_point_attempts_total", "_three", 100),
        "creation_mix": c("pull_up_frequency") + c("step_back_frequency") + 0.5 * c("midrange_frequency"),
        "interior_mix": c("rim_frequency") + c("paint_frequency") + 0.5 * (c("dunk_frequency") + c("layup_frequency")),
    }).drop("_efg", "_three", *[f"_m_{x}" for x in SHOT_MIX])
    out = with_traits(out, keys, VECTOR_TRAITS, ["season"])
    context = {"minutes_per_game": True} | ({"plus_minus_per_game": True} if "plus_minus_per_game" in out.columns else {})
    out = percentiles(out, keys, context, ["season"]).withColumnRenamed("pct_minutes_per_game", "role_strength")
    sure = c("minutes_total") / (c("minutes_total") + 1000)
    out = out.withColumn("impact_context", clip(0.5 + (c("pct_plus_minus_per_game") - 0.5) * sure) if "plus_minus_per_game" in context else F.lit(0.5))
    out = out.withColumn("rate_quality", reduce(lambda a, b: a + b, [F.lit(w) * c(f"trait_{t}") for t, w in QUALITY.items()]))
    proxy = 0.80 * c("rate_quality") + 0.10 * c("role_strength") + 0.10 * c("impact_context")
    if impact is not None:
        out = out.join(one_each(impact.select(*keys, "dpm", "o_dpm", "d_dpm"), keys), keys, "left")
        proxy = F.coalesce(logistic(finite(c("dpm"))), proxy)
        out = out.withColumn("impact_source", F.when(finite(c("dpm")).isNotNull(), "impact rating").otherwise("box-score fallback"))
    out = out.withColumn("quality", proxy)
    parts = [(0.45, c("minutes_total") / 1200), (0.35, c("games_played") / 55), (0.20, F.coalesce(c("shot_attempts"), F.lit(0)) / 300)]
    out = out.withColumn("data_reliability", reduce(lambda a, b: a + b, [F.lit(w) * F.least(F.lit(1.0), x) for w, x in parts]))
    if people is not None:
        place = people.select("player_id", labels.position(c("guard"), c("forward"), c("center")).alias("position"))
        out = out.join(one_each(place, ["player_id"]), "player_id", "left").fillna("N/A", ["position"])
    return out.drop("pct_plus_minus_per_game")
