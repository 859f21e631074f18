"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Every input partition p with n_p rows sends c[p, b] rows to output block b. The matrix c has the law of a uniformly
random permutation of all rows: the split of each set of partitions into two halves is one multivariate hypergeometric
draw, and the draws down a binary tree over the partitions give the row of a single partition. A task walks the tree for
its own partition alone, with generators seeded by the node, so no task and no driver holds the matrix.

1. permute locally: sort each partition by a keyed hash of its rows;
2. label: the first c[p, 0] rows go to block 0, the next c[p, 1] to block 1, ...;
3. exchange by block (the only shuffle, about block_rows rows a task);
4. permute again: sort each block by a second keyed hash; a row's slot is the block's known offset plus its rank.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh, materialize, row_hash

#: numpy draws populations below this; larger ones take _hypergeometric.
NUMPY_LIMIT = 10**9


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones in `draws` draws without replacement, for populations of any size."""
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if draws == total or bad == 0:
        return min(draws, good)
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    # Ratio of uniforms around the mode, with the density in logarithms.
    lo, hi = max(0, draws - bad), min(good, draws)
    log_p = lambda x: -(math.lgamma(x + 1) + math.lgamma(good - x + 1) + math.lgamma(draws - x + 1) + math.lgamma(bad - draws + x + 1))
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    top = log_p(mode)
    spread = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / (total - 1)) + 1)
    centre, width = draws * good / total + 0.5, spread * 1.7155277699214135 + 0.8989161620588988
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(centre + width * (v - 0.5) / u)
        if lo <= x <= hi and 2 * math.log(u) <= log_p(x) - top:
            return x


def _split(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """How many of each colour are among `draws` draws without replacement."""
    total = int(sizes.sum())
    if draws == 0:
        return np.zeros_like(sizes)
    if draws == total:
        return sizes.copy()
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(sizes, draws, method="marginals")
    if len(sizes) == 1:
        return np.array([draws], dtype=sizes.dtype)
    half = len(sizes) // 2
    left = int(sizes[:half].sum())
    taken = _hypergeometric(rng, left, total - left, draws)
    return np.concatenate([_split(rng, sizes[:half], taken), _split(rng, sizes[half:], draws - taken)])


def matrix_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix: rows that partition `part` sends to each block."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, left = 0, len(counts), sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _split(np.random.default_rng([seed, lo, hi]), left, int(before[mid] - before[lo]))
        lo, hi, left = (lo, mid, first) if part < mid else (mid, hi, left - first)
    return left


def block_sizes(total: int, shards: int, blocks: int) -> np.ndarray:
    """Sizes of the blocks, shard by shard; shards differ by one row at most."""
    each = [total // shards + (s < total % shards) for s in range(shards)]
    return np.array([(b + 1) * m // blocks - b * m // blocks for m in each for b in range(blocks)], dtype=np.int64)


def shard(df: DataFrame, n_shards: int, *, seed: int = 20, block_rows: int = 16384, stable_input: bool = False) -> DataFrame:
    """All rows and columns of df plus shard (0 .. n_shards - 1) and slot (gapless from 0 within a shard).

    Shard sizes differ by at most one row and the order is a uniformly random permutation for the seed.
    df's partitions must hold the same rows whenever they are computed: pass stable_input for a plain
    scan of files, else df is written to the shared folder first.

    Nulls are values like any other. Repeated rows are rows of their own and get slots of their own. An empty df
    gives an empty result. Columns of df named shard or slot are replaced.
    """
    src = df if stable_input else materialize(df, "shard-input")
    kept = [c for c in src.columns if c not in ("shard", "slot")]
    found = src.groupBy(F.spark_partition_id().alias("p")).count().collect()  # a row a partition
    counts = np.zeros(max([r["p"] for r in found], default=-1) + 1, dtype=np.int64)
    for r in found:
        counts[r["p"]] = r["count"]
    total = int(counts.sum())
    blocks = max(1, -(-total // (n_shards * block_rows)))
    sizes = block_sizes(total, n_shards, blocks)
    ends: dict[int, np.ndarray] = {}

    @F.pandas_udf("long")
    def block_of(part: pd.Series, pos: pd.Series) -> pd.Series:
        out = np.empty(len(part), dtype=np.int64)
        p, at = part.to_numpy(), pos.to_numpy()
        for one in np.unique(p):
            if one not in ends:
                ends.clear()
                ends[one] = np.cumsum(matrix_row(counts, sizes, int(one), seed)) if one < len(counts) else np.zeros(1)
            if at[p == one].max() >= ends[one][-1]:
                raise ValueError("a partition has more rows than when they were counted; the input must be written first")
            out[p == one] = np.searchsorted(ends[one], at[p == one], side="right")
        return pd.Series(out)

    base, rest = divmod(total, n_shards)
    h, at, block, rank = fresh(kept, "h", "id", "block", "rank")
    numbered = src.select(*[F.col(f"`{c}`") for c in kept], row_hash(src, seed).alias(h)).sortWithinPartitions(h)
    numbered = numbered.withColumn(at, F.monotonically_increasing_id())  # partition << 33 | position
    labelled = numbered.withColumn(block, block_of(F.shiftrightunsigned(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))))
    placed = labelled.withColumn(rank, F.row_number().over(Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + 1), h), h)))
    shard_no = F.expr(f"cast({block} div {blocks} as int)")
    start = F.expr(f"(({block} % {blocks}) * ({base} + if({block} div {blocks} < {rest}, 1, 0))) div {blocks}")
    return placed.select(*[F.col(f"`{c}`") for c in kept], shard_no.alias("shard"), (start + F.col(rank) - 1).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: law `rows`. A null text has size 1 and the checksum of no bytes."""
    from tallyforge.llm.common import table

    out = shard(table(spark, sf_dir, "documents"), 8, stable_input=True)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
