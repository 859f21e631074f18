"""Labels by rule: seasons, season types, zones, actions, tiers, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Season type by a part of the text (first match counts), and by the first digits of a game's id.
SEASON_TYPES = [("all.star", "all_star"), ("playoff", "playoffs"), ("in-season tournament", "regular"), ("in season tournament", "regular"), ("regular", "regular")]
GAME_PREFIXES = {"002": "regular", "004": "playoffs", "001": "preseason"}
#: Least score of each tier, and least attempts of each grade of reliability.
TIERS = [(0.95, "elite"), (0.90, "very strong"), (0.85, "strong"), (0.80, "clear"), (0.70, "moderate"), (0.60, "loose")]
SAMPLES = [(800, "High"), (400, "Medium")]


def season_label(start: Column) -> Column:
    """1999 -> 1999-00."""
    return F.format_string("%04d-%02d", start.cast("int"), ((start + 1) % 100).cast("int"))


def season_ending(end: Column) -> Column:
    """2000 -> 1999-00."""
    return season_label(end - 1)


def season_of(date: Column, first_month: int = 9) -> Column:
    return season_label(F.year(date) - F.when(F.month(date) >= first_month, 0).otherwise(1))


def season_start(label: Column) -> Column:
    return F.substring_index(label, "-", 1).try_cast("int")


def season_type(text: Column) -> Column:
    lower = F.lower(F.trim(text))
    out = F.when(text.isNull() | (lower == "unknown"), "unknown")
    for part, name in SEASON_TYPES:
        out = out.when(lower.rlike(part), name)
    return out.otherwise("other")


def game_id_type(game_id: Column) -> Column:
    digits = F.lpad(F.regexp_replace(game_id.cast("string"), r"\.0$", ""), 10, "0")
    out = F.when(F.lit(False), "")
    for prefix, name in GAME_PREFIXES.items():
        out = out.when(digits.startswith(prefix), name)
    return out.otherwise("other")


#: The rules of zone() and action(), their order and their words are fixed values.
def zone(name: Column, distance: Column) -> Column:
    """Where a shot was taken; a missing distance counts as 0, and so as at the rim."""
    low, far = F.lower(F.coalesce(name, F.lit(""))), F.greatest(F.coalesce(distance, F.lit(0.0)), F.lit(0.0))
    return (
        F.when(F.contains(low, F.lit("restricted")) | (far <= 4), "rim")
        .when(F.contains(low, F.lit("paint")), "paint")
        .when(low.rlike("mid-?range"), "midrange")
        .when(F.contains(low, F.lit("3")) | (far >= 23), "three_point")
        .otherwise("other")
    )


def action(name: Column) -> Column:
    """Kind of a shot; special moves come before the families they belong to."""
    rules = [("step[ -]back", "step_back"), ("pull[ -]?up", "pull_up"), ("float", "floater"), ("hook", "hook"), ("dunk", "dunk"), ("layup|finger roll", "layup")]
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.when(F.lit(False), "")
    for pattern, kind in rules:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise("other")


def tier(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in TIERS:
        out = out.when(score >= least, name)
    return out.otherwise("distant")


def sample_grade(attempts: Column) -> Column:
    out = F.when(attempts.isNull(), "Unavailable")
    for least, name in SAMPLES:
        out = out.when(attempts >= least, name)
    return out.otherwise("Limited")


def position(guard: Column, forward: Column, center: Column) -> Column:
    flags = [F.when(F.coalesce(c.cast("int"), F.lit(0)) == 1, k) for c, k in ((guard, "G"), (forward, "F"), (center, "C"))]
    return F.coalesce(F.nullif(F.concat_ws("-", *flags), F.lit("")), F.lit("N/A"))


def positions_meet(reference: Column, candidate: Column, empty_meets_all: bool = True) -> Column:
    known = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "-"), lambda t: t.isin("G", "F", "C"))
    meet = F.arrays_overlap(known(reference), known(candidate))
    return (F.size(known(reference)) == 0) | meet if empty_meets_all else meet


def age_on(birth: Column, day: Column) -> Column:
    """Whole years; who was born on 29 February is older from 1 March on."""
    before = F.date_format(day, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(day) - F.year(birth) - F.when(before, 1).otherwise(0)


def ordinal(n: Column) -> Column:
    tens, ones = n % 100, n % 10
    end = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def percent_text(share: Column) -> Column:
    return F.when(share.isNull(), "–").otherwise(F.format_string("%.1f%%", F.lit(100.0) * share))
