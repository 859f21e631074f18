"""Evidence packets: numbered facts with formatted values, and reports made from them by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_text(value: Column, kind: str) -> Column:
    """percent, integer or number with one decimal; a dash for null."""
    form = {"percent": F.format_string("%.1f%%", F.lit(100.0) * value), "integer": F.format_string("%d", F.round(value).cast("long")), "number": F.format_string("%.1f", value)}[kind]
    return F.when(value.isNull(), "–").otherwise(form)


def evidence_rows(rows: DataFrame, key: str, metrics: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each present metric of each key, numbered E1, E2, ... in the order of `metrics` without gaps."""
    facts = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), value_text(F.col(c).cast("double"), kind).alias("shown"))) for c, kind in metrics]
    listed = rows.select(key, F.posexplode(F.array_compact(F.array(*facts))).alias("n", "fact"))
    return listed.select(key, F.concat(F.lit("E"), (F.col("n") + 1).cast("string")).alias("evidence_id"), "fact.metric", "fact.value", "fact.shown")


def packets(evidence: DataFrame, key: str) -> DataFrame:
    """One JSON packet a key; a key has as many facts as there are metrics."""
    fact = F.struct(F.regexp_extract("evidence_id", r"\d+", 0).cast("int").alias("n"), "evidence_id", "metric", "value", "shown")
    return evidence.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(fact)), lambda f: F.struct(f["evidence_id"].alias("id"), f["metric"].alias("metric"), f["value"].alias("value"), f["shown"].alias("shown")))).alias("packet"))


def reports(evidence: DataFrame, key: str, high: dict[str, tuple[float, str]]) -> DataFrame:
    """A short report a key: each metric over its threshold becomes a sentence that cites its evidence."""
    rule = F.when(F.lit(False), "")
    for metric, (least, said) in high.items():
        rule = rule.when((F.col("metric") == metric) & (F.col("value") >= least), said)
    said = evidence.withColumn("said", rule).withColumn("line", F.when(F.col("said").isNotNull(), F.format_string("%s (%s) [%s].", "said", "shown", "evidence_id")))
    lines = F.array_sort(F.collect_list(F.struct(F.regexp_extract("evidence_id", r"\d+", 0).cast("int").alias("n"), "line")))
    return said.groupBy(key).agg(F.coalesce(F.nullif(F.array_join(F.transform(F.filter(lines, lambda x: x["line"].isNotNull()), lambda x: x["line"]), " "), F.lit("")), F.lit("No stated threshold is met.")).alias("report"))


def melt(rows: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keys), list(measures), "metric", "value")


def reliable_long_range(tried: Column, made: Column) -> Column:
    """Whether a long-range share has enough behind it: 25 tries and 5 makes."""
    return (F.coalesce(tried, F.lit(0)) >= 25) & (F.coalesce(made, F.lit(0)) >= 5)


def comparison_rows(pairs: DataFrame, evidence: DataFrame, a: str, b: str, key: str, shares: Sequence[str]) -> DataFrame:
    """Each metric that both of a pair have: values, citations, and whether they are close (0.02 for shares, else 1)."""
    side = lambda name, p: evidence.select(F.col(key).alias(name), "metric", F.col("evidence_id").alias(f"{p}_id"), F.col("value").alias(f"{p}_value"), F.col("shown").alias(f"{p}_shown"))
    both = pairs.select(a, b).join(side(a, "a"), a).join(side(b, "b"), [b, "metric"])
    edge = F.when(F.col("metric").isin(*shares), 0.02).otherwise(1.0)
    return both.withColumn("close", F.abs(F.col("a_value") - F.col("b_value")) <= edge)


def comparison_reports(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A text for each pair: what is close, what differs, and which of them has more of each, every value with its citation."""
    line = F.format_string("%s: %s [%s] and %s [%s]", "metric", "a_shown", "a_id", "b_shown", "b_id")
    lead = F.when(F.col("a_value") >= F.col("b_value"), F.col(a).cast("string")).otherwise(F.col(b).cast("string"))
    item = F.struct(F.col("metric"), F.col("close"), line.alias("line"), F.format_string("%s leads in %s", lead, F.col("metric")).alias("lead"))
    packed = rows.groupBy(a, b).agg(F.array_sort(F.collect_list(item)).alias("m"))  # as many as there are metrics
    some = lambda keep, field: F.array_join(F.transform(F.filter("m", keep), lambda x: x[field]), "; ")
    either = lambda text, none: F.coalesce(F.nullif(text, F.lit("")), F.lit(none))
    text = F.concat(F.lit("Close: "), either(some(lambda x: x["close"], "line"), "none"), F.lit(". Apart: "), either(some(lambda x: ~x["close"], "line"), "none"), F.lit(". "), some(lambda x: ~x["close"], "lead"))
    return packed.select(a, b, F.trim(text).alias("report"))


def match_evidence(matches: DataFrame, query: str, match: str, features: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Evidence of each match of each query: a row a feature with both values, the gap and its share of the distance, cited M<rank>E<n>.

    matches has rank, ref_<feature> and <feature> (percentiles).
    """
    gap = lambda f: F.col(f) - F.col(f"ref_{f}")
    total = sum((F.lit(weights[f]) * gap(f) * gap(f) for f in features), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(i + 1).alias("n"), F.lit(f).alias("feature"), F.col(f"ref_{f}").alias("reference_value"), F.col(f).alias("match_value"), F.abs(gap(f)).alias("gap"), F.coalesce(F.try_divide(F.lit(weights[f]) * gap(f) * gap(f), F.nullif(total, F.lit(0.0))), F.lit(0.0)).alias("contribution")) for i, f in enumerate(features)])
    long = matches.select(query, match, "rank", F.explode(cells).alias("c")).select(query, match, "rank", "c.*")
    return long.withColumn("evidence_id", F.format_string("M%dE%d", "rank", "n"))


def match_reports(evidence: DataFrame, query: str, match: str, most: int = 3) -> DataFrame:
    """A sentence for each of the first matches: its two smallest gaps and the feature with the largest share of its distance."""
    item = lambda *by: F.array_sort(F.collect_list(F.struct(*by, F.format_string("%s [%s]", "feature", "evidence_id").alias("said"))))
    packed = evidence.filter(F.col("rank") <= most).groupBy(query, match, "rank").agg(item(F.col("gap"), F.col("n")).alias("near"), item((-F.col("contribution")).alias("c"), F.col("n")).alias("far"))
    near = F.array_join(F.transform(F.slice("near", 1, 2), lambda x: x["said"]), ", ")
    return packed.select(query, match, "rank", F.concat(F.lit("closest in "), near, F.lit("; farthest in "), F.element_at("far", 1)["said"]).alias("explanation"))


def needs_lines(gaps: DataFrame, names: dict[str, str], most: int = 4) -> DataFrame:
    """The largest gaps of a team as numbered, cited sentences; shares and rates as percentages."""
    share = F.col("feature").rlike("percentage|_rate|_share|assist_ratio")
    shown = lambda c: F.when(share, F.format_string("%.2f%%", 100 * F.col(c))).otherwise(F.format_string("%.2f", c))
    top = gaps.filter("priority > 0").orderBy(F.desc("priority"), "feature").limit(most)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("priority"), "feature"))  # at most `most` rows
    named = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("trait"))
    said = F.concat(F.col("feature"), F.lit(" is "), shown("team_value"), F.lit(" against "), shown("elite_median"), F.lit(" of the best, who want it "), F.col("desired"), F.lit(": look for a "), named)
    return top.withColumn("n", place).select(F.concat(F.lit("E"), F.col("n").cast("string")).alias("evidence_id"), "feature", F.concat(said, F.lit(" [E"), F.col("n").cast("string"), F.lit("].")).alias("line"))


def trend_sentences(trends: DataFrame, key: str) -> DataFrame:
    """One sentence a key from its trends (metric, direction, prior, recent): what moved, or that nothing did."""
    moved = F.when(F.col("direction") != "steady", F.format_string("%s went %s from %.2f to %.2f", "metric", "direction", "prior", "recent"))
    packed = trends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("metric", moved.alias("said")))).alias("t"))
    said = F.array_join(F.transform(F.filter("t", lambda x: x["said"].isNotNull()), lambda x: x["said"]), "; ")
    return packed.select(key, F.when(said == "", "Steady in both windows.").otherwise(F.concat(said, F.lit("."))).alias("sentence"))
