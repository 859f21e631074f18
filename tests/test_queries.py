"""Each registered query against its SQL; those without SQL against what must hold of their rows."""

from __future__ import annotations

import pytest

from tallyforge.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_minutes_fill_each_roster(spark, sf_dir):
    groups: dict[int, list[float]] = {}
    for r in QUERIES["minutes_waterfill"](spark, sf_dir).collect():
        groups.setdefault(r["s_nationkey"], []).append(r["minutes"])
    assert groups
    for minutes in groups.values():
        assert max(minutes) <= 48 + 1e-6 and min(minutes) >= 0
        positive = sum(m > 0 for m in minutes)
        assert sum(minutes) == pytest.approx(min(240, 48 * positive), abs=1e-3)


def test_predictions_are_in_range(spark, sf_dir):
    knn = QUERIES["knn_cv"](spark, sf_dir).collect()
    labels = [r["label"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label").distinct().collect()]
    assert len(knn) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert all(min(labels) - 1e-9 <= r["predicted"] <= max(labels) + 1e-9 for r in knn)
    assert {r["predicted"] for r in QUERIES["logistic_fit"](spark, sf_dir).collect()} <= {0, 1}
    ridge = QUERIES["ridge_fit"](spark, sf_dir).collect()
    mean = sum(r["total"] for r in ridge) / len(ridge)
    assert sum((r["total"] - r["predicted"]) ** 2 for r in ridge) < sum((r["total"] - mean) ** 2 for r in ridge)


def test_every_number_of_a_report_is_in_its_evidence(spark, sf_dir):
    assert QUERIES["evidence_packets"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert QUERIES["scouting_reports"](spark, sf_dir).count() > 0


def test_folded_names_ignore_accents(spark, sf_dir):
    rows = QUERIES["folded_names"](spark, sf_dir).collect()
    assert all("ring" in r["p_name"].lower() or r["distance"] > 0 for r in rows)
