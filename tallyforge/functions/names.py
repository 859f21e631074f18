"""Search by name: literal tiers first, spelling distance only if none hits."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Decomposed, without anything but letters and digits, lower-case. There is no such function in the JVM."""
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if c.isalnum()).lower()
    return text.map(fold, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_words(text: pd.Series) -> pd.Series:
    """The words of a text, parted by white space, each as folded() has it."""
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if c.isalnum()).lower()
    return text.map(lambda t: [fold(w) for w in t.split()], na_action="ignore")


def folded_ascii(text: Column) -> Column:
    """The same for ASCII texts, without leaving the JVM."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def search(rows: DataFrame, name: str, query: str, *, most_edits: int = 2, ascii_only: bool = False) -> DataFrame:
    """Rows with priority (0 the name or a word of it, 1 a word's start, 2 a part, 3 near spelling) and distance."""
    fold = (lambda c: folded_ascii(c)) if ascii_only else (lambda c: folded(c))
    wanted = "".join(c for c in unicodedata.normalize("NFKD", query) if c.isalnum()).lower()
    if not wanted:
        return rows
    edits = 1 if len(wanted) <= 3 else most_edits
    q = F.lit(wanted)
    full = rows.withColumn("_full", fold(F.col(name)))
    if ascii_only:
        full = full.withColumn("_words", F.transform(F.split(F.trim(F.col(name)), r"\s+"), folded_ascii))
    else:
        full = full.withColumn("_words", folded_words(F.col(name)))
    tier = (
        F.when((F.col("_full") == q) | F.array_contains("_words", wanted), 0)
        .when(F.exists("_words", lambda w: w.startswith(wanted)), 1)
        .when(F.contains("_full", q), 2)
        .otherwise(3)
    )
    near = F.array_min(F.transform(F.filter(F.concat(F.array("_full"), F.col("_words")), lambda w: w != ""), lambda w: F.levenshtein(w, q)))
    found = full.withColumn("priority", tier).withColumn("distance", F.when(F.col("priority") < 3, 0).otherwise(near)).filter(F.col("distance") <= edits)
    literal = found.filter("priority < 3").select(F.lit(True).alias("_literal")).limit(1)
    kept = found.join(F.broadcast(literal), F.lit(True), "left").filter(F.col("_literal").isNull() | (F.col("priority") < 3))
    return kept.drop("_full", "_words", "_literal")


def within(rows: DataFrame, team: str | None, name: str, query: str) -> DataFrame:
    """Rows of a team (or all) whose name contains the text as it stands, in any case."""
    rows = rows.filter(F.col("team") == team) if team else rows
    text = query.strip()
    return rows.filter(F.contains(F.lower(F.col(name)), F.lit(text.lower()))) if text else rows


def resolve(rows: DataFrame, team: str, name: str, query: str, **how) -> DataFrame:
    """search() in the team; if the best hit of all rows is strictly better, those of all rows. Adds league_wide."""
    everywhere = search(rows, name, query, **how)
    local = search(within(rows, team, name, query), name, query, **how)
    best = lambda df, c: df.agg(F.min(F.struct("priority", "distance")).alias(c))
    relaxed = best(everywhere, "_l").join(F.broadcast(best(local, "_t"))).select((F.col("_l").isNotNull() & (F.col("_t").isNull() | (F.col("_l") < F.col("_t")))).alias("league_wide"))  # a row each
    flag = F.broadcast(relaxed)
    return local.join(flag).filter("not league_wide").unionByName(everywhere.join(flag).filter("league_wide"))


def candidates(rows: DataFrame, name: str, key: str, team: str | None = None, without: list | None = None) -> DataFrame:
    """Rows to choose from, by name, team and key: those of a team only, without some keys."""
    rows = rows.filter(F.col("team") == team) if team else rows
    rows = rows.filter(~F.col(key).isin(*without)) if without else rows
    return rows.orderBy(name, "team", key)


def active_columns(rows: DataFrame, columns: list[str], least: int = 2) -> list[str]:
    """The columns with at least so many values; one aggregation."""
    counts = rows.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] >= least]
