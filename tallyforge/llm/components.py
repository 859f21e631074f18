"""Connected components of a graph of any shape, in few rounds of shuffles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, join_skewed, materialize


def _towards_least(edges: DataFrame, total: int, larger_only: bool) -> DataFrame:
    """Tie the neighbours of each u (v of the edges (u, v)) to the least of them and u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = join_skewed(edges, least, "u", "n", total).withColumn("m", F.least("m", "u"))
    if larger_only:
        return tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = tied.select("u", F.col("m").alias("v"))
    return own.unionByName(tied.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node but the roots, for edges (a, b).

    Alternates two steps until the edges are stars around the roots: each node ties its larger neighbours to the least
    one, then each ties its smaller neighbours and itself to the least of them. Nodes with very many neighbours are
    shared out. Rounds are written to the shared folder. An edge with a null end and one from a node to itself tie nothing;
    repeated edges count once; no edges give no rows; other columns are ignored.
    """
    clean = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(clean, "edges")
    # All edges lead to roots once no node that is led to leads on.
    while not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or not _single(now):
        total = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, 2 * total, True)
        large = materialize(large.filter(F.col("u") != F.col("v")).distinct(), "edges")
        small = _towards_least(large, large.count(), False)
        before, now = now, materialize(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        discard(edges.sparkSession, before, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _single(edges: DataFrame) -> bool:
    """Whether each u has one v."""
    return edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least that it reaches over the pairs (i, j)."""
    least, before = np.arange(n), None
    while before is None or (least != before).any():
        before = least.copy()
        m = np.minimum(least[i], least[j])
        np.minimum.at(least, i, m)
        np.minimum.at(least, j, m)
        least = least[least]
    return least
