"""Mixing sources to target weights by pivotal dependent rounding.

A document of source s is wanted target_s / size_s times: a whole part, which is settled at once, and a fraction p.
The fractions are rounded in pairs. Mass, counted in words, moves between a document and those paired with it until it
is 0 or 1; the direction is random, such that each document's expected copies stay what they were. So the
words of a source are kept exactly at each step, and what is left in the end is one fraction a source.

The pairs form a tree. Rows are dealt to buckets by a hash; each bucket is read in order, largest documents first, and
keeps one residual a source. Residuals of fan_in buckets meet on the next level, until one is left; a last draw settles it.
A source of any share of the rows is spread over all buckets, and a task holds one residual a source.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh, materialize, row_hash, table

WORDS = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def targets(sizes: dict[str | None, int], *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: share of all sizes by weight, none above most times its size.

    weights go to the sources by code point, null last, and repeat. What is above a source's most is shared by
    weight among the others, until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def _open(p: float) -> bool:
    return EPS < p < 1 - EPS


class Rounder:
    """Rounds units [p, size, uid] that come largest first; done gets those with p of 0 or 1.

    One unit is open. Those that come next are paired with it until, together, they can make up for either of its
    outcomes: each takes the share of the open unit's words that neither outcome pushes beyond 0 or 1. Then one draw
    settles it, they give or take their shares, and what is still a fraction is next. If one alone suffices, that is a pair.
    """

    def __init__(self, rng: random.Random):
        self.rng, self.open, self.pairs, self.share = rng, None, [], 0.0
        self.done: list[list] = []

    def add(self, unit: list) -> None:
        queue = deque([unit])
        while queue:
            b = queue.popleft()
            if not _open(b[0]):
                self.done.append([float(round(b[0])), *b[1:]])
                continue
            if self.open is None:
                self.open = b
                continue
            p, words, _ = self.open
            x = min(b[0] * b[1] / ((1 - p) * words), (1 - b[0]) * b[1] / (p * words), 1 - self.share)
            self.pairs.append((b, x * words))
            self.share += x
            if self.share >= 1 - EPS:
                up = self.rng.random() < p
                self.done.append([float(up), *self.open[1:]])
                queue.extendleft([c[0] + (-(1 - p) if up else p) * w / c[1], *c[1:]] for c, w in reversed(self.pairs))
                self.open, self.pairs, self.share = None, [], 0.0

    def finish(self) -> list | None:
        """Pair what is left two by two; the residual, if there is one."""
        rest = self.open
        for b, _ in self.pairs:
            if rest is None:
                rest = b
                continue
            up = min((1 - rest[0]) * rest[1], b[0] * b[1])  # rest takes so many words from b,
            down = min(rest[0] * rest[1], (1 - b[0]) * b[1])  # or gives so many
            words = up if self.rng.random() * (up + down) < down else -down
            both = [[rest[0] + words / rest[1], *rest[1:]], [b[0] - words / b[1], *b[1:]]]
            self.done += [[float(round(u[0])), *u[1:]] for u in both if not _open(u[0])]
            rest = next((u for u in both if _open(u[0])), None)
        self.open, self.pairs, self.share = None, [], 0.0
        return rest


def _level(seed: int, level: int):
    """Round the fractions of each (bucket, source), in the order of the rows; p is 0, 1 or, of one row, a residual."""

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["bucket", "source_no", "p", "size", "uid"]).astype({"p": "float64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rounder = None, None

        def ended() -> list:
            rest = rounder.finish()
            return rounder.done + ([rest] if rest is not None else [])

        for pdf in batches:
            out = []
            for bucket, source, p, size, uid in zip(pdf["bucket"], pdf["source_no"], pdf["p"], pdf["size"], pdf["uid"], strict=True):
                if (bucket, source) != group:
                    if group is not None:
                        out += [(*group, *u) for u in ended()]
                    group, rounder = (bucket, source), Rounder(random.Random(f"{seed}/{level}/{bucket}/{source}"))
                rounder.add([p, size, uid])
            out += [(*group, *u) for u in rounder.done] if group is not None else []
            if group is not None:
                rounder.done = []
            yield frame(out)
        if group is not None:
            yield frame([(*group, *u) for u in ended()])

    return run


SCHEMA = "bucket long, source_no int, p double, size long, uid long"


def pivotal(rows: DataFrame, *, seed: int, bucket_rows: int = 50_000, fan_in: int = 64) -> DataFrame:
    """source_no, uid and up (p rounded to 0 or 1) for rows of (source_no, uid, size > 0, 0 < p < 1).

    (source_no, uid) is a key and nothing is null; rows of a size of 0 or a p of 0 or 1 are not for this. No rows give no rows.
    In a source the sum of size times up stays within one size of the sum of size times p. Other columns are ignored.
    """
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    now = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "uid", "source_no"), F.lit(buckets)))
    settled, level = [], 0
    while True:
        # In a bucket the smallest documents come last, so what is left over is small.
        dealt = now.repartition("bucket").sortWithinPartitions("bucket", "source_no", F.desc("size"), "uid")
        done = materialize(dealt.select("bucket", "source_no", "p", "size", "uid").mapInPandas(_level(seed, level), SCHEMA), "pivotal")
        open_ = F.col("p").between(EPS, 1 - EPS)
        settled.append(done.filter(~open_))
        now = done.filter(open_)
        if buckets == 1:
            break
        buckets, level = -(-buckets // fan_in), level + 1
        now = now.withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "uid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = now.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0))
    for s in settled:
        out = out.unionByName(s)
    return out.select("source_no", "uid", F.col("p").cast("long").alias("up"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _named(source: Column) -> Column:
    """A key for a source that is null for none."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", seed: int = 40, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, prefix: str = "") -> DataFrame:
    """docs with size, source_size, target (of its source, in words), copies (0 to ceil(most)) and taken, each with the prefix.

    One row for each row of docs; repeat_copies() writes them out. The sizes of the sources, a number
    each, go to the driver. A null or wordless text has size 0 and no copies. A null source is a source. Rows that repeat
    each other are rows of their own; together they get what as many rows would. An empty docs gives an empty result.
    Columns of docs with these names are replaced.
    """
    docs = docs.drop(*[prefix + c for c in ("size", "source_size", "target", "copies", "taken")])
    rows = docs.select(row_hash(docs, seed).alias("_h"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    keys = rows.groupBy("_h", "source").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    keys = materialize(keys, "mix-keys")
    sizes = {r["source"]: int(r["size"]) for r in keys.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).collect()}
    goal = targets(sizes, weights=weights, share=share, most=most)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(s, i, sizes[s], float(goal[s]), goal[s] / sizes[s] if sizes[s] else 0.0) for i, s in enumerate(sizes)],
        "source string, source_no int, source_size long, target double, rate double",
    )
    # Rows that repeat each other are one unit here: n rows at this rate are n * rate copies.
    keys = keys.join(plan, keys["source"].eqNullSafe(plan["source"])).select("_h", keys["source"], "size", "n", "source_no", "source_size", "target", (F.when(F.col("size") > 0, F.col("n") * F.col("rate")).otherwise(0.0)).alias("wanted"))
    keys = keys.withColumn("whole", F.floor(F.col("wanted") + EPS).cast("long"))
    keys = keys.withColumn("p", F.greatest(F.col("wanted") - F.col("whole"), F.lit(0.0)))
    open_ = keys.filter(F.col("p") > EPS).select("source_no", F.col("_h").alias("uid"), "size", "p")
    rounded = pivotal(open_, seed=seed).withColumnRenamed("uid", "_h")
    h, s, k, up, size, n, source_size, target = fresh(docs.columns, "h", "s", "k", "copies", "size", "n", "source_size", "target")
    found = {h: F.col("_h"), s: _named(F.col("source")), size: F.col("size"), n: F.col("n"), source_size: F.col("source_size"), target: F.col("target"), up: F.col("whole") + F.coalesce("up", F.lit(0))}
    settled = keys.join(rounded, ["_h", "source_no"], "left").select(*[c.alias(name) for name, c in found.items()])

    # The k-th of n equal rows gets an equal part of the copies, the first ones one more.
    # The window and the join have the same plain keys, so the rows move once.
    numbered = docs.withColumn(h, row_hash(docs, seed)).withColumn(s, _named(F.col(f"`{source}`").cast("string")))
    numbered = numbered.withColumn(k, F.row_number().over(Window.partitionBy(h, s).orderBy(h)))
    copies = F.expr(f"{up} div {n} + if({k} <= {up} % {n}, 1, 0)").cast("long")
    out = numbered.join(settled, [h, s])
    more = {"size": F.col(size), "source_size": F.col(source_size), "target": F.col(target), "copies": copies, "taken": copies * F.col(size)}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(prefix + name) for name, c in more.items()])


def repeat_copies(mixed: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """Each row of mixed as often as its copies say, with these columns; null or no copies: not at all."""
    copies = F.col(f"{prefix}copies")
    times = mixed.filter(copies > 0).withColumn(*fresh(mixed.columns, "n"), F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return times.select(*[F.col(f"`{c}`") for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op4: sources weigh 3, 1, 2, repeating, and share 150 % of all words; at most twice each."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
