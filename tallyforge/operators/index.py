"""Approximate search over cells of vectors, and how much of the exact search it finds.

Centroids are fitted on a bounded sample, but every row is put into the cell of its nearest centroid. A query looks into the cells
whose centroids are nearest to it and scores exactly those of their rows that may be among its best (retrieval.leaders). How many cells it takes is measured on the sample, for a recall that
is asked for. Large cells are parted, so no task holds a cell. retrieval.top_matches() is the exact search.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.retrieval import BLOCK_ROWS, WIDE_BLOCKS, WIDE_ROWS, Cosines, leaders, matrix, side, units
from tallyforge.sources.scratch import kept

SAMPLE_ROWS = 20_000  # rows that centroids are fitted on
MOST_CELLS = 4096  # so centroids, which tasks hold, have a bounded size
ASKED = 200  # rows of the sample on which recall is measured


@dataclass(frozen=True)
class Cells:
    """Unit centroids, how many of them a query looks into, and the recall that so many had on the sample."""

    centroids: np.ndarray
    probes: int
    recall: float

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells of each row, nearest first; ties to the smaller number."""
        return np.argsort(-(units(x) @ self.centroids.T), axis=1, kind="stable")[:, :n]


def _centroids(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, units(sums), c)
    return c


def fit(rows: DataFrame, key: str, vector: str, *, n: int = 10, recall: float = 0.97, sample_rows: int = SAMPLE_ROWS, cells: int | None = None) -> Cells:
    """Cells for rows: about as many as the square root of the rows, MOST_CELLS at most.

    The sample is the rows of the least hashes of their keys, sample_rows at most, and all the driver gets. The number of probes is the least with
    which the mean share of the n nearest rows of the sample that some of its rows find is `recall`.
    """
    total = rows.filter(F.col(vector).isNotNull()).count()
    picked = rows.filter(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(17), key).alias("_h"), F.col(vector).alias("_v")).orderBy("_h").limit(sample_rows)
    found = picked.toArrow()
    if not found.num_rows:
        return Cells(np.zeros((1, 1)), 1, 1.0)
    x = units(matrix(found, "_v"))
    cells = max(1, min(MOST_CELLS, len(x), cells or round(total**0.5)))
    c = _centroids(x, cells)
    of = np.argmax(x @ c.T, axis=1)
    asked = np.arange(min(ASKED, len(x)))
    sims = x[asked] @ x.T
    sims[asked, asked] = -np.inf
    near = np.argsort(-sims, axis=1, kind="stable")[:, : min(n, max(1, len(x) - 1))]
    place = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1, kind="stable"), axis=1)  # of each cell for each asked row
    needed = np.sort(place[asked[:, None], of[near]].ravel())  # probes with which each neighbour is found
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return Cells(c, probes, float((needed < probes).mean()))


def cells_of(vector: Column, index: Cells, n: int) -> Column:
    """The n cells of a vector, nearest first; null for null."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def of(v: pa.Array) -> pa.Array:
        has = np.flatnonzero(np.asarray(v.is_valid()))
        out: list = [None] * len(v)
        if len(has):
            x = v.take(pa.array(has)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(has), -1)
            for i, cells in zip(has.tolist(), index.nearest(x, n).tolist(), strict=True):
                out[i] = cells
        return pa.array(out, type=pa.list_(pa.int32()))

    return of(vector)


def near_matches(queries: DataFrame, rows: DataFrame, key: str, vector: str, n: int, index: Cells, *, carry: Sequence[str] = (), apart: str | None = None) -> DataFrame:
    """As retrieval.top_matches(), among the rows of the cells that each query looks into: query, key, cosine, carried columns, rank.
    apart names a column of which a match has another value than the query.

    Neighbouring numbers of cells make a group of about a block of rows, and a query moves once for each group in which it looks into a cell,
    not once a cell: vectors without clusters have to look into most cells. A row is in one group and moves once for each block of queries
    of it. Rows without a vector match nothing.
    """
    cols = list(dict.fromkeys([key, vector, *carry, *([apart] if apart else [])]))
    kind = dict(rows.dtypes)
    r = kept(rows.select(*cols).withColumn("_cells", cells_of(F.col(vector), index, 1)).filter("_cells is not null"), "cells")
    q = kept(queries.select(*cols).withColumn("_cells", cells_of(F.col(vector), index, index.probes)).filter("_cells is not null"), "probes")
    total = r.count()
    block = min(WIDE_ROWS, max(BLOCK_ROWS, -(-total // WIDE_BLOCKS)))
    per = max(1, len(index.centroids) * block // max(1, total))  # cells of a group
    of = lambda c: F.floor(c / per).cast("int")
    q = q.withColumn("_group", F.explode(F.array_distinct(F.transform("_cells", of)))).withColumn("_cells", F.filter("_cells", lambda c: of(c) == F.col("_group")))
    r = r.withColumn("_group", of(F.get("_cells", F.lit(0))))
    parts = lambda df, name: df.groupBy("_group").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(parts(r, "_rows").join(parts(q, "_queries"), "_group"))  # a row a group, MOST_CELLS at most
    own = lambda c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    placed = lambda df, s, a, b: df.join(sizes, "_group").withColumn("_side", F.lit(s)).withColumn("_r", a).withColumn("_q", b)
    both = placed(q, 0, every("_rows"), own("_queries")).unionByName(placed(r, 1, own("_rows"), every("_queries")))

    def best(pair: pa.Table) -> pa.Table:
        a, b = side(pair, 0, key), side(pair, 1, key)
        ks, ids = a.column(key).to_numpy(), b.column(key).to_numpy()
        first = per * pair.column("_group")[0].as_py()
        asked, cell = a.column("_cells").combine_chunks(), b.column("_cells").combine_chunks().flatten().to_numpy() - first
        looks = np.zeros((len(ks), per), dtype=bool)
        looks[np.repeat(np.arange(len(ks)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy() - first] = True
        codes: dict = {}
        mine, other = (np.array([codes.setdefault(x, len(codes)) for x in t.column(apart).to_pylist()], dtype=np.int64) if apart else None for t in (a, b))
        drop = lambda i, j: ~looks[i, cell[j]] | (ks[i] == ids[j]) | (mine[i] == other[j] if apart else False)
        qi, ri, cosine = leaders(Cosines(matrix(a, vector), matrix(b, vector)), n, drop)
        return pa.table({"query": a.column(key).take(pa.array(qi)), key: b.column(key).take(pa.array(ri)), "cosine": cosine, **{c: b.column(c).take(pa.array(ri)) for c in carry}})

    found = both.groupBy("_group", "_q", "_r").applyInArrow(best, f"query {kind[key]}, {key} {kind[key]}, cosine double" + "".join(f", {c} {kind[c]}" for c in carry))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), key))
    return found.withColumn("rank", place).filter(F.col("rank") <= n)


def near_pairs(rows: DataFrame, key: str, vector: str, other_than: str, n: int, index: Cells, *, each: int = 20) -> DataFrame:
    """The n pairs of different other_than with the largest cosine, of those in which one is among the other's `each` nearest."""
    pairs = near_matches(rows, rows, key, vector, each, index, apart=other_than)
    pairs = pairs.select(F.least("query", key).alias("a"), F.greatest("query", key).alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return pairs.orderBy(F.desc("cosine"), "a", "b").limit(n)


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row: queries, and the share of the exact matches (query, key) that were found."""
    hit = exact.select("query", key).join(found.select("query", key, F.lit(1).alias("_hit")), ["query", key], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
