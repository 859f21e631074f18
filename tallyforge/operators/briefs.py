"""Reports from typed packets: a scouting brief of a player's season, and the packet and text of a roster simulation.

A packet is one struct a row, of lists of facts that each carry their citation; it goes to JSON and back without loss. Texts are
put together from packets alone, in the JVM, so every value in a text has its citation, and text.report_checks() can hold it to the packet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.evidence import reliable_long_range, value_text

#: From how much on a season shows a strength, and the share of long shots that spaces a floor.
MANY_POINTS, MANY_ASSISTS, MANY_REBOUNDS, GOOD_LONG_RANGE = 15, 5, 7, 0.35
ZONES = ["rim", "paint", "midrange", "three_point"]
KINDS = ["dunk", "layup", "floater", "hook", "pull_up", "step_back"]
#: Facts of a brief in the order of their citations: column, what it is called, how it is shown.
FACTS = [
    ("points_per_game", "points a game", "number"), ("rebounds_per_game", "rebounds a game", "number"), ("assists_per_game", "assists a game", "number"), ("turnovers_per_game", "turnovers a game", "number"), ("three_point_percentage", "long-range share made", "percent"),
    *[(f"{z}_frequency", f"share of tries: {z.replace('_', ' ')}", "percent") for z in ZONES], *[(f"{k}_frequency", f"share of tries: {k.replace('_', ' ')}", "percent") for k in KINDS], ("shot_making_above_expected", "makes above expectation", "percent"),
]
BRIEF_SECTIONS = ["## In short", "## Strong points", "## Watch", "## Lately", "## Fits best", "## Evidence", "## How sure"]
SIMULATION_SECTIONS = ["## Outcome", "## What changes", "## Closest teams", "## Still lacking", "## How sure"]


def _lines(parts: Column, none: str, sep: str = "\n") -> Column:
    return F.coalesce(F.nullif(F.array_join(F.array_compact(parts), sep), F.lit("")), F.lit(none))


#: Words of a question by which its topic is told, the first topic that has one; and points and assists of a role.
TOPICS = [
    ("recent", ["underperform", "changed", "recent", "trend"]), ("role", ["facilitator", "playmaker", "scorer"]),
    ("shots", ["shot selection", "shot type", "difficulty", "floater", "pull-up", "pullup", "step-back", "step back", "midrange", "rim", "layup", "dunk"]), ("long_range", ["spacing", "shoot", "three"]),
]
HUB_POINTS, HUB_ASSISTS, SCORER_POINTS = 20, 7, 18


def topic(question: Column, has_shots: Column) -> Column:
    """recent, role, shots (only of a season that has them), long_range, or none, by the words of a question in any case."""
    low, out = F.lower(F.coalesce(question, F.lit(""))), F.lit("none")
    for name, words in reversed(TOPICS):
        met = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(met & has_shots if name == "shots" else met, name).otherwise(out)
    return out


def answers(rows: DataFrame, key: str, question: str = "question", *, trend: str = "trend") -> DataFrame:
    """key, question, topic and answer: what a season's facts say to a question, with their citations, or that they say nothing.

    rows as in scouting_briefs(), and the question. The citations are those of the brief.
    """
    c = F.col
    rows = _with_facts(rows)
    points, assists = _number("points_per_game"), _number("assists_per_game")
    role = F.when((points >= HUB_POINTS) & (assists >= HUB_ASSISTS), "scores and creates alike").when(points >= SCORER_POINTS, "scores first").when(assists >= MANY_ASSISTS, "creates first").when(F.array_contains(F.split(F.coalesce("position", F.lit("N/A")), "-"), "C"), "finishes and rebounds, and neither scores nor creates first").otherwise("comes second in scoring and creating")
    told = {
        "recent": F.concat(c("player_name"), F.lit(": "), F.coalesce(c(trend), F.lit("too few games for two windows.")), F.lit(" Why isn't in the data.")),
        "role": F.concat(c("player_name"), F.lit(" "), role, F.lit(": "), _shown("points_per_game"), F.lit(" points "), _cite("points_per_game"), F.lit(", "), _shown("assists_per_game"), F.lit(" assists "), _cite("assists_per_game"), F.lit(".")),
        "shots": F.concat(c("player_name"), F.lit(" shoots most from "), _most(ZONES), F.lit(", most by "), _most(KINDS), F.lit(". Defenders aren't in the data.")),
        "long_range": F.when(_long_range() & c("three_point_percentage").isNotNull(), F.concat(c("player_name"), F.lit(" makes "), _shown("three_point_percentage"), F.lit(" of long shots "), _cite("three_point_percentage"), F.when(c("three_point_frequency").isNotNull(), F.concat(F.lit(", which are "), _shown("three_point_frequency"), F.lit(" of all "), _cite("three_point_frequency"))).otherwise(""), F.lit("."))).otherwise(F.concat(c("player_name"), F.lit(" has too few long shots to tell."))),
        "none": F.concat(F.lit("The facts of "), c("player_name"), F.lit(" don't answer that; they tell of scoring, creating, shots, long range and recent games.")),
    }
    of = topic(c(question), _has_shots())
    said = F.element_at(F.create_map(*[x for name, t in told.items() for x in (F.lit(name), t)]), of)
    return rows.select(key, question, of.alias("topic"), said.alias("answer"))


def _with_facts(rows: DataFrame) -> DataFrame:
    """rows with _s_<metric> (how it is shown) and _i_<metric> (its citation), null where it lacks, and _f, the facts that are there."""
    has = [F.col(m).isNotNull() for m, _, _ in FACTS]
    place = [sum((h.cast("int") for h in has[:at]), F.lit(1)) for at in range(len(FACTS))]
    rows = rows.withColumns({f"_s_{m}": F.when(h, value_text(F.col(m).cast("double"), kind)) for (m, _, kind), h in zip(FACTS, has, strict=True)} | {f"_i_{m}": F.when(h, F.concat(F.lit("E"), n.cast("string"))) for (m, _, _), h, n in zip(FACTS, has, place, strict=True)})
    facts = [F.when(h, F.struct(F.col(f"_i_{m}").alias("id"), F.lit(m).alias("metric"), F.lit(said).alias("said"), F.col(m).cast("double").alias("value"), F.col(f"_s_{m}").alias("shown"))) for (m, said, _), h in zip(FACTS, has, strict=True)]
    return rows.withColumn("_f", F.array_compact(F.array(*facts)))


def _cite(m: str) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.col(f"_i_{m}"), F.lit("]")), F.lit("[no data]"))


def _shown(m: str) -> Column:
    return F.coalesce(f"_s_{m}", F.lit("0.0"))


def _number(m: str) -> Column:
    return F.coalesce(F.col(m).cast("double"), F.lit(0.0))


def _long_range() -> Column:
    games = _number("games_played")
    return reliable_long_range(_number("three_point_attempts_per_game") * games, _number("three_points_made_per_game") * games)


def _has_shots() -> Column:
    out = F.col("shot_making_above_expected").isNotNull()
    for x in ZONES + KINDS:
        out = out & F.col(f"{x}_frequency").isNotNull()
    return out


def _most(names: Sequence[str]) -> Column:
    """The first of the largest shares among names, with its citation."""
    best, out = F.greatest(*[F.col(f"{z}_frequency") for z in names]), F.lit(None)
    for z in reversed(names):
        out = F.when(F.col(f"{z}_frequency") == best, F.concat(F.lit(f"{z.replace('_', ' ')}, "), _shown(f"{z}_frequency"), F.lit(" of tries "), _cite(f"{z}_frequency"))).otherwise(out)
    return out


def scouting_briefs(rows: DataFrame, key: str, *, trend: str = "trend") -> DataFrame:
    """key, packet (the facts that a season has, cited E1, E2, ... without gaps, as JSON) and report, for each row.

    rows has player_name, position ("G-F"), season, games_played, the columns of FACTS (a season without shots has them null), the long-range tries and
    makes a game, and trend, a sentence or null. Missing stats count as 0 and have no citation. Long range counts only with 25 tries and 5
    makes behind it. Shares of zones and kinds of tries are told of only where a season has all of them; of equal ones the first is told.
    """
    c, cite, shown, number, long_range = F.col, _cite, _shown, _number, _long_range()
    rows = _with_facts(rows)
    spaces = long_range & (number("three_point_percentage") >= GOOD_LONG_RANGE)

    said = lambda text, m: F.concat(F.lit(f"- {text}: "), shown(m), F.lit(" "), cite(m), F.lit("."))
    strong = F.array(
        F.when(number("points_per_game") >= MANY_POINTS, said("Scores a lot", "points_per_game")), F.when(number("assists_per_game") >= MANY_ASSISTS, said("Creates for others", "assists_per_game")),
        F.when(number("rebounds_per_game") >= MANY_REBOUNDS, said("Rebounds", "rebounds_per_game")), F.when(spaces, said("Makes long shots, with enough tries behind it", "three_point_percentage")),
    )
    three = ["points_per_game", "rebounds_per_game", "assists_per_game"]
    line = F.concat_ws(", ", *[F.concat(shown(m), F.lit(f" {m.split('_')[0]} "), cite(m)) for m in three])
    strong = _lines(strong, "")
    strong = F.when(strong != "", strong).otherwise(F.concat(F.lit("- A part in all of it: "), line, F.lit(".")))

    shots = _has_shots()
    chosen = F.when(shots, F.concat(F.lit("\n- Shoots most from: "), _most(ZONES), F.lit(".\n- Shoots most by: "), _most(KINDS), F.lit("."))).otherwise("")
    above = number("shot_making_above_expected")
    watched = F.when(shots, F.concat(F.lit("- Makes "), value_text(F.abs(above), "percent"), F.when(above >= 0, " more").otherwise(" less"), F.lit(" than such tries usually bring "), cite("shot_making_above_expected"), F.lit("; who guarded them isn't known."))).otherwise("- Shots, their defenders and line-ups aren't in the data.")
    first = F.split(F.coalesce("position", F.lit("N/A")), "-")[0]
    role = F.when((first == "G") & (number("assists_per_game") >= MANY_ASSISTS), "runs the offence with the ball").when(first == "G", "plays off the ball on the perimeter").when(first == "C", "finishes and rebounds inside").when(first == "F", "plays on the wing").otherwise("is used for what the numbers show")
    floor = F.when(spaces, "wants shooters around the ball").otherwise("has its spacing from others")
    told = F.coalesce(c(trend), F.lit("Too few games for two windows."))
    listed = F.concat_ws("\n", *[F.concat(F.lit("- ["), c(f"_i_{m}"), F.lit(f"] {name}: "), c(f"_s_{m}")) for m, name, _ in FACTS])
    report = F.concat(
        F.lit(BRIEF_SECTIONS[0] + "\n"), c("player_name"), F.lit(" in "), c("season"), F.lit(": "), line, F.lit(f".\n\n{BRIEF_SECTIONS[1]}\n"), strong, chosen,
        F.lit(f"\n\n{BRIEF_SECTIONS[2]}\n- Loses the ball "), shown("turnovers_per_game"), F.lit(" times a game "), cite("turnovers_per_game"), F.lit("; how often it is held isn't known.\n"), watched,
        F.lit(f"\n\n{BRIEF_SECTIONS[3]}\n"), told, F.lit(f"\n\n{BRIEF_SECTIONS[4]}\nA player who "), role, F.lit(", in a line-up that "), floor, F.lit(" "), cite("assists_per_game"), F.lit(" "), cite("three_point_percentage"),
        F.lit(f".\n\n{BRIEF_SECTIONS[5]}\n"), listed, F.lit(f"\n\n{BRIEF_SECTIONS[6]}\nGood for what the season's numbers say, poor for what they don't: health, defence and context."),
    )
    return rows.select(key, F.to_json("_f").alias("packet"), report.alias("report"))


#: The type of a simulation's packet.
SIMULATION = """struct<season: string, added: array<string>, removed: array<string>, validated: boolean,
quality: array<struct<id: string, label: string, value: double, low: double, high: double>>, support: struct<id: string, supported: boolean, ratio: double>, talent: struct<id: string, percentile: double>,
changes: array<struct<id: string, trait: string, baseline: double, simulated: double, change: double>>, profiles: array<struct<id: string, profile: string, score: double>>,
neighbours: array<struct<id: string, team: string, season: string, wins: int, games: int, net_rating: double, similarity: double>>,
rotation: array<struct<id: string, player: string, observed: double, minutes: double, share: double>>>"""
#: Fixed value: a change of the net rating below this isn't told from none.
RESOLUTION = 0.05


def cited(rows: DataFrame, key: str, fields: Sequence[str], order: Sequence[Column], mark: str, most: int) -> DataFrame:
    """key and facts: the first `most` rows of each key in an order, as structs of the fields with ids mark1, mark2, ..."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= most)
    fact = F.struct("_r", F.concat(F.lit(mark), F.col("_r").cast("string")).alias("id"), *fields)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(fact)), lambda f: F.struct(f["id"].alias("id"), *[f[x].alias(x) for x in fields])).alias("facts"))  # at most `most`


def simulation_packets(rosters: DataFrame, key: str, *, changes: DataFrame, profiles: DataFrame, neighbours: DataFrame, rotation: DataFrame) -> DataFrame:
    """key and packet (a struct of type SIMULATION), for each row of rosters.

    rosters has season, added and removed (names), validated, net_rating, base_net_rating, wins_low, wins_high, is_supported, distance_ratio and
    talent_percentile; the others have the key and their facts. A packet has the 6 largest changes, 5 profiles and 5 neighbours by
    score, 20 players by minutes. The estimates Q1 to Q4 are only there where the roster is supported and has no unproven moves: a roster with
    moves has none until `validated` says that such moves have been tested. Facts that a roster lacks are empty lists; null moves are none.
    """
    c = F.col
    lists = {
        "changes": cited(changes, key, ["trait", "baseline", "simulated", "change"], [F.desc(F.abs("change")), c("trait")], "C", 6), "profiles": cited(profiles, key, ["profile", "score"], [F.desc("score"), c("profile")], "P", 5),
        "neighbours": cited(neighbours, key, ["team", "season", "wins", "games", "net_rating", "similarity"], [F.desc("similarity"), c("team"), c("season")], "N", 5), "rotation": cited(rotation, key, ["player", "observed", "minutes", "share"], [F.desc("minutes"), c("player")], "R", 20),
    }
    out = rosters
    for name, facts in lists.items():
        out = out.join(facts.withColumnRenamed("facts", f"_{name}"), key, "left")
    moves = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    unproven = (F.size(moves("added")) + F.size(moves("removed")) > 0) & ~F.coalesce("validated", F.lit(False))
    none = F.lit(None).cast("double")
    fact = lambda i, label, value, low=none, high=none: F.struct(F.lit(f"Q{i}").alias("id"), F.lit(label).alias("label"), value.alias("value"), low.alias("low"), high.alias("high"))
    net, base = c("net_rating").cast("double"), c("base_net_rating").cast("double")
    four = F.array(fact(1, "net rating before", base), fact(2, "net rating after", net), fact(3, "difference", net - base), fact(4, "wins, 80 in 100", none, c("wins_low").cast("double"), c("wins_high").cast("double")))
    supported = F.coalesce("is_supported", F.lit(True))
    packet = F.struct(
        c("season"), moves("added").alias("added"), moves("removed").alias("removed"), (~unproven).alias("validated"), F.when(supported & ~unproven & net.isNotNull() & base.isNotNull(), four).otherwise(F.array().cast("array<struct<id: string, label: string, value: double, low: double, high: double>>")).alias("quality"),
        F.struct(F.lit("S1").alias("id"), supported.alias("supported"), c("distance_ratio").cast("double").alias("ratio")).alias("support"), F.struct(F.lit("T1").alias("id"), c("talent_percentile").cast("double").alias("percentile")).alias("talent"),
        *[F.coalesce(c(f"_{n}"), F.array()).alias(n) for n in lists],
    )
    return out.select(key, packet.cast(SIMULATION).alias("packet"))


def simulation_reports(packets: DataFrame, key: str) -> DataFrame:
    """key and report, for each packet: of unproven moves, of a roster beyond support, of no change that can be told, or of a change."""
    c = F.col
    p = lambda name: c("packet")[name]
    q = lambda i: F.get(p("quality"), F.lit(i - 1))
    joined = lambda word, names: F.when(F.size(names) > 0, F.concat(F.lit(word), F.array_join(names, ", ")))
    moved = F.coalesce(F.nullif(F.concat_ws(" and ", joined("adding ", p("added")), joined("removing ", p("removed"))), F.lit("")), F.lit("no moves"))
    beyond = F.when(p("support")["ratio"].isNotNull(), F.format_string("%.1f times as far as history reaches", p("support")["ratio"])).otherwise("farther than history reaches")
    talent = F.when(p("talent")["percentile"].isNotNull(), F.format_string(" Its talent is at percentile %.0f of history, which is no forecast [T1].", p("talent")["percentile"])).otherwise("")
    outside = F.when(p("support")["supported"], "").otherwise(F.concat(F.lit(" It also lies "), beyond, F.lit(" [S1].")))
    wins = F.coalesce(F.format_string(" In 80 of 100 cases that is %.0f to %.0f wins [Q4].", q(4)["low"], q(4)["high"]), F.lit(""))
    signed = lambda x: F.format_string("%+.1f", x)
    outcome = (
        F.when(~p("validated"), F.concat(F.lit("no change of wins is given, for such moves haven't been tested on history [V1]."), outside, talent))
        .when(~p("support")["supported"], F.concat(F.lit("no estimate is given, for the roster lies "), beyond, F.lit(" [S1]."), talent))
        .when(F.size(p("quality")) == 0, "no estimate is given, for the model has none.")
        .when(F.abs(q(3)["value"]) < RESOLUTION, F.concat(F.lit("nothing changes that the model can tell: "), signed(q(1)["value"]), F.lit(" [Q1] and "), signed(q(2)["value"]), F.format_string(" [Q2] differ by less than %.2f [Q3].", F.lit(RESOLUTION)), wins))
        .otherwise(F.concat(F.lit("the net rating "), F.when(q(3)["value"] > 0, "rises").otherwise("falls"), F.lit(" from "), signed(q(1)["value"]), F.lit(" [Q1] to "), signed(q(2)["value"]), F.lit(" [Q2], a difference of "), signed(q(3)["value"]), F.lit(" [Q3]."), wins))
    )
    each = lambda facts, most, line, none: _lines(F.transform(F.slice(facts, 1, most), line), none)
    at = lambda f: F.concat(F.lit(" ["), f["id"], F.lit("]."))
    changes = each(p("changes"), 4, lambda f: F.concat(F.lit("- "), f["trait"], F.format_string(": from %.0f%% to %.0f%%, %+.0f%%", 100 * f["baseline"], 100 * f["simulated"], 100 * f["change"]), at(f)), "- Nothing that was measured.")
    profiles = each(p("profiles"), 3, lambda f: F.concat(F.lit("- "), f["profile"], F.format_string(": %.0f%%", 100 * f["score"]), at(f)), "- No profiles.")
    near = each(p("neighbours"), 3, lambda f: F.concat(F.lit("- "), f["team"], F.lit(", "), f["season"], F.format_string(": %d won, %d lost, net rating %+.1f", f["wins"], f["games"] - f["wins"], f["net_rating"]), at(f)), "- None are known.")
    weak = each(F.reverse(F.slice(p("profiles"), F.greatest(F.lit(1), F.size(p("profiles")) - 1), F.lit(2))), 2, lambda f: F.concat(F.lit("- "), f["profile"], F.format_string(", at %.0f%%", 100 * f["score"]), at(f)), "- Nothing that the packet shows.")
    new = F.filter(p("rotation"), lambda f: F.array_contains(p("added"), f["player"]))
    minutes = each(new, 20, lambda f: F.concat(F.lit("- "), f["player"], F.format_string(": %.1f minutes before, %.1f here", f["observed"], f["minutes"]), at(f)), "- Nobody new.")
    a, b, d, e, g = SIMULATION_SECTIONS
    report = F.concat(
        F.lit(f"{a}\nAfter "), moved, F.lit(": "), outcome, F.lit(f"\n\n{b}\n"), changes, F.lit("\nMinutes of those added:\n"), minutes, F.lit("\nStrongest profiles:\n"), profiles,
        F.lit(f"\n\n{d}\n"), near, F.lit(f"\n\n{e}\n"), weak, F.lit(f"\n\n{g}\nGood for comparing rosters with each other, poor for what moves cause. The text adds nothing to the packet."),
    )
    return packets.select(key, report.alias("report"))
