"""Audit of how filters interact, over a packed bitmap index.

Every row becomes one number: a bit for each filter that it fails, one for each label. A task lays the rows of a batch
out by part, each part from a new 64-bit word on, so a part's own bitset is a run of words, and packs a bitset for each filter
and label. Survivors of a set of filters are those of the set without its last filter AND NOT that filter's bitset; counts of
one bits over a part's words give how many are kept, how many of them good and toxic. Tasks pass on their counts for
each part and set of filters; their sums tell everything about every order of the filters, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import join_skewed, materialize, table

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
HELD = 4096  # parts of which a task holds the counts
COUNTS = ("kept", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: few words, repeated words, capitals, symbols. A null text is an empty one."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    # Words are cut once: the struct is made before its fields are read.
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    tests = [n["all"] < 100, n["distinct"] * 100 < n["all"] * 80, capitals.cast("long") * 100 > F.length(t).cast("long") * 10, t.rlike("[#$%&*|]")]
    return _bits(tests)


def _bits(tests: Sequence[Column]) -> Column:
    bits = F.lit(0)
    for i, test in enumerate(tests):
        bits = bits + F.when(test, F.lit(1 << i)).otherwise(0)
    return bits


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part and state of each row of docs: bits 0 to 4 for the filters A to E that it fails, 5 if it is good, 6 if toxic.

    A row fails E if its text is also that of a smaller id anywhere in docs; a null id is neither smaller nor larger than
    another, and rows that repeat an id and its text don't fail through each other. A null part is the empty string. A
    label holds if any row of labels with the id says 1; rows without one, and those with a null id, have none. No docs, no rows.
    Other columns, whatever their names, aren't read.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), named, F.unhex(F.sha2(F.encode(t, "UTF-8"), 256)).alias("digest"), text_failures(t).alias("bits"))
    rows = materialize(rows, "failures")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = join_skewed(rows, materialize(first, "first"), "digest", "n", rows.count(), how="left")
    rows = rows.select("id", "part", (F.col("bits") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).alias("bits"))
    label = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 32).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 64).otherwise(0)).alias("toxic"))
    known = rows.filter("id is not null").join(label.filter("id is not null"), "id", "left")
    state = F.col("bits") + F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))
    return known.select("part", state.alias("state")).unionByName(rows.filter("id is null").select("part", F.col("bits").alias("state")))


def subset_counts(part: np.ndarray, state: np.ndarray, parts: int, filters: int) -> np.ndarray:
    """[part, set of filters, (kept, good, toxic)] of rows with part numbers 0 to parts - 1 and states."""
    order = np.argsort(part, kind="stable")
    part, state = part[order], state[order]
    rows = np.bincount(part, minlength=parts)
    words = -(-rows // 64)
    start = np.concatenate([[0], np.cumsum(words)[:-1]])
    place = 64 * start[part] + np.arange(len(part)) - (np.cumsum(rows) - rows)[part]

    def packed(ones: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * int(words.sum()), dtype=np.uint8)
        bits[place] = ones
        return np.packbits(bits).view(np.uint64)

    alive = {0: packed(np.ones(len(part), dtype=np.uint8))}
    fails = [packed(state >> f & 1) for f in range(filters)]
    labels = [None, packed(state >> filters & 1), packed(state >> (filters + 1) & 1)]
    out = np.zeros((parts, 1 << filters, len(labels)), dtype=np.int64)
    for chosen in range(1 << filters):
        if chosen:
            last = chosen.bit_length() - 1
            alive[chosen] = alive[chosen ^ 1 << last] & ~fails[last]
        for at, label in enumerate(labels):
            ones = np.bitwise_count(alive[chosen] if label is None else alive[chosen] & label)
            out[:, chosen, at] = np.add.reduceat(ones, start, dtype=np.int64)
    return out


def prefix_counts(rows: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """part, chosen (a set of filters as bits), and how many rows that all of them pass are kept, good and toxic.

    rows has part and state. The result has 2 ** filters rows a part, whatever the number of rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def passed_on() -> pa.RecordBatch:
            names = [p for p in held for _ in range(1 << filters)]
            flat = np.concatenate(list(held.values()))
            chosen = np.tile(np.arange(1 << filters), len(held))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(chosen), *(pa.array(flat[:, i]) for i in range(len(COUNTS)))], ["part", "chosen", *COUNTS])

        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            found = subset_counts(coded.indices.to_numpy(), b.column(1).to_numpy(), len(coded.dictionary), filters)
            for p, x in zip(coded.dictionary.to_pylist(), found, strict=True):
                held[p] = held[p] + x if p in held else x
            if len(held) > HELD:
                yield passed_on()
                held.clear()
        if held:
            yield passed_on()

    made = rows.select("part", "state").mapInArrow(count, "part string, chosen long, kept long, good long, toxic long")
    return made.groupBy("part", "chosen").agg(*[F.sum(c).alias(c) for c in COUNTS])


def report(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each step of each order of the filters does in each part, from prefix_counts().

    Columns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley. Every part has
    all orders and steps, zeros included; no parts give no rows.
    """
    n, every = len(letters), (1 << len(letters)) - 1
    rows = F.array_sort(F.collect_list(F.struct("chosen", *COUNTS)))  # 2 ** n of a part
    parts = counts.groupBy("part").agg(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in COUNTS])).alias("by"))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])).alias("filter_order")
    steps = parts.select("part", "by", orders).select("part", "by", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    before = F.lit(0)
    for i, letter in enumerate(letters):
        before = before + F.when(F.instr("filter_order", letter) < F.col("step"), 1 << i).otherwise(0)
    own = F.lit(0)
    for i, letter in enumerate(letters):
        own = F.when(F.instr("filter_order", letter) == F.col("step"), 1 << i).otherwise(own)
    steps = steps.select("*", before.alias("before"), own.alias("own"))

    def gone(chosen: Column, what: str) -> Column:
        return F.get("by", chosen)[what] - F.get("by", chosen.bitwiseOR(F.col("own")))[what]

    ways = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)])  # orders with a set before a filter
    sets = F.filter(F.sequence(F.lit(0), F.lit(every)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    shapley = F.aggregate(sets, F.lit(0).cast("long"), lambda a, s: a + F.get(ways, F.bit_count(s)) * gone(s, "kept"))
    removed = gone(F.col("before"), "kept")
    others = F.lit(every).bitwiseXOR(F.col("own"))
    return steps.select(
        "part", "filter_order", "step",
        F.get("by", F.col("before").bitwiseOR(F.col("own")))["kept"].alias("kept"), removed.alias("removed"),
        (gone(F.lit(0), "kept") - removed).alias("redundant"), gone(others, "kept").alias("unique_fails"),
        gone(F.col("before"), "good").alias("good_lost"), gone(F.col("before"), "toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the audit of the five filters over documents."""
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return report(prefix_counts(rows))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(LETTERS))

#: By the first filter of an order that a document fails.
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT * FROM (VALUES {_ORDERS}) AS v(filter_order)),
r AS (SELECT g.*, filter_order, unnest([1, 2, 3, 4, 5]) AS step,
  least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 9 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 9 END, CASE WHEN c THEN strpos(filter_order, 'C') ELSE 9 END,
    CASE WHEN d THEN strpos(filter_order, 'D') ELSE 9 END, CASE WHEN e THEN strpos(filter_order, 'E') ELSE 9 END) AS stop FROM g, o),
x AS (SELECT *, substr(filter_order, step, 1) AS letter FROM r),
y AS (SELECT *, CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails FROM x),
z AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, sum(CASE WHEN stop > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN stop = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND stop < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN stop = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN stop = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM y GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM z
"""
