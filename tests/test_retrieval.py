"""Ranks beyond any cut, against brute force."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge.operators import retrieval
from tallyforge.plans.queries import QUERIES


def test_metrics_count_a_first_hit_at_any_rank(spark, tmp_path):
    """One query of label 1; 60 rows of label 0 are nearer than its one hit, two of them as near but of larger and smaller id."""
    turn = lambda a: [math.cos(a), math.sin(a)]
    rows = [(0, 1, turn(0.0)), (2, 7, turn(0.0))] + [(2 * i + 1, 0, turn(0.01 * (i + 1))) for i in range(60)]
    rows += [(131, 1, turn(1.0)), (129, 0, turn(1.0)), (133, 0, turn(1.0)), (135, 1, turn(1.2))]
    kinds = [("vec_id", pa.int64()), ("label", pa.int32()), ("embedding", pa.list_(pa.float64()))]
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds)}), tmp_path / "embeddings.parquet")
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumnRenamed("embedding", "v").repartition(3)
    found = retrieval.first_hit_rank(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "v", "label")
    assert dict(map(tuple, found.collect())) == {0: 62, 2: None}
    r = QUERIES["retrieval_metrics"](spark, str(tmp_path)).first()
    assert (r["queries"], r["recall_at_5"], r["median_rank"]) == (2, 0, 62)
    assert r["mrr"] == pytest.approx(1 / 62 / 2, abs=1e-6)
