"""Hot keys are spread, and no pair that links is lost on the way to its comparison."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, jaccard
from tallyforge.llm.common import discard, join_skewed, materialize
from tallyforge.llm.shingles import PartEnum, _beyond, odd_bits, odd_gap, parity, part_enum, shared_pairs


def test_one_key_with_three_quarters_of_the_rows_is_spread(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        rows = spark.range(40_000).select("id", F.when(F.col("id") % 4 > 0, -1).when(F.col("id") % 16 == 0, None).otherwise(F.col("id") % 5000).alias("k"))
        rows = materialize(rows.repartition(8), "rows")
        counted = materialize(rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")), "counted")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = join_skewed(rows, counted, "k", "n", 40_000)
        assert out.columns == ["id", "k", "n", "m"]
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == rows.filter("k is not null").count() and max(sizes) <= 1.5 * 40_000 / rows.rdd.getNumPartitions()  # as they are read
        left = join_skewed(rows, counted, "k", "n", 40_000, how="left")
        assert left.count() == 40_000 and left.filter("m is null").count() == rows.filter("k is null").count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (4, 5), (1, 2)])
def test_similar_sets_not_both_like_the_pivot_share_a_pair(num, den):
    rng, enum, met = random.Random(num), PartEnum(num, den), 0
    like = lambda a, b: den * len(a & b) >= num * len(a | b)
    for _ in range(1500):
        pivot = set(rng.sample(range(10**6), rng.choice([3, 10, 40, 200])))
        def changed(s, share):
            s = set(s)
            for e in rng.sample(sorted(s), int(share * len(s))):
                s.discard(e)
                if rng.random() < 0.7:
                    s.add(rng.randrange(10**6))
            return s
        x = changed(pivot, rng.random() * 0.4)
        y = changed(x, rng.random() * 0.3)
        if not x or not y or not like(x, y) or (like(x, pivot) and like(y, pivot)):
            continue
        d = [np.array(sorted(s ^ pivot), dtype=np.uint64) for s in (x, y)]
        assert set(shared_pairs(d[0], len(x), enum).tolist()) & set(shared_pairs(d[1], len(y), enum).tolist())
        bits = [int.from_bytes(parity(v).tobytes(), "little") for v in d]
        assert bin(bits[0] ^ bits[1]).count("1") <= len(x ^ y)
        met += 1
    assert met > 20


def test_groups_that_need_further_rounds_end_right(spark, monkeypatch):
    """With nothing compared at once, all is left to pivots."""
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "COMPARED", 0)
    rng, texts = random.Random(8), []
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    for _ in range(12):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(80)] = f"x{rng.randrange(900)}"
        texts.append(" ".join(t))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(78)} for t in texts]
    root = list(range(12))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(12):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in jaccard.link(docs, words=3, num=80, den=100).collect()}
    assert [got[i] for i in range(12)] == [find(i) for i in range(12)]


def test_discarded_tables_are_gone_and_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    df = materialize(spark.range(3), "gone")
    discard(spark, df, None)
    with pytest.raises(Exception, match="(?i)exist|not found|FILE"):
        spark.read.parquet(df.inputFiles()[0].rpartition("/")[0]).count()

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"getConf": staticmethod(lambda: Conf())})

    with pytest.raises(ValueError, match="no folder"):
        common.shared_dir(Session())


@pytest.mark.parametrize(("num", "den"), [(90, 100), (4, 5)])
def test_parity_bits_never_part_sets_that_link(num, den):
    rng, apart = random.Random(num), 0
    for _ in range(600):
        n = rng.choice([1, 3, 30, 64, 65, 400, 1100])
        x = rng.sample(range(10**9), n)
        y = set(x)
        for e in rng.sample(x, rng.randrange(0, n // 3 + 1)):
            y.discard(e)
            if rng.random() < 0.6:
                y.add(rng.randrange(10**9))
        if not y:
            continue
        a, b = (np.array(sorted(s), dtype=np.uint64) for s in (x, y))
        gap = odd_gap(odd_bits(a), odd_bits(b))
        assert gap == odd_gap(odd_bits(b), odd_bits(a)) <= len(set(x) ^ y)
        other = np.array(sorted(rng.sample(range(10**9, 2 * 10**9), n)), dtype=np.uint64)
        differ = odd_gap(odd_bits(a), odd_bits(other))
        apart += n >= 30 and den * (2 * n - differ) < num * (2 * n + differ)
    assert apart > 250  # unrelated sets are told apart by their bits alone


def test_ties_of_many_sets_stay_and_those_of_few_go_by_their_bits(spark, monkeypatch):
    """A signature of many classes ties them all to one; of a few, only pairs whose bits allow a link."""
    rng = random.Random(3)
    sets = {h: np.array(sorted(rng.sample(range(10**9), 200)), dtype=np.uint64) for h in range(1, 30)}
    sets[2] = np.concatenate([sets[1][:-3], [np.uint64(7)]])
    classes = [(h.to_bytes(8, "little") + b"x" * 8, len(s), odd_bits(np.sort(s))) for h, s in sets.items()]
    rows = [(100, 1, False), (100, 2, False), (100, 3, False)] + [(200, h, False) for h in range(10, 20)] + [(300, 21, True), (300, 22, False), (400, 25, False)]
    shared = spark.createDataFrame(rows, "sig long, h long, many boolean")
    nodes = spark.createDataFrame(classes, "cls binary, n long, bits binary")
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    got = jaccard._ties(shared, nodes, 4, 5).collect()
    assert {(r["a"], r["b"]) for r in got} == {(2, 1), (22, 21)} | {(h, 10) for h in range(11, 20)}
    monkeypatch.setattr(jaccard, "BUCKET", 4096)  # then a task looks at the bits of all ten, and nothing may link
    assert {(r["a"], r["b"]) for r in jaccard._ties(shared, nodes, 4, 5).collect()} == {(2, 1), (22, 21)}


@pytest.mark.parametrize(("num", "den"), [(90, 100), (4, 5)])
def test_trees_hold_together_all_that_may_link(num, den):
    rng = random.Random(5)
    for _ in range(30):
        sets = []
        for _ in range(rng.randrange(1, 40)):
            s = set(rng.choice(sets)) if sets and rng.random() < 0.6 else set(rng.sample(range(10**9), rng.choice([20, 60, 70, 128, 129, 300])))
            for e in rng.sample(sorted(s), rng.randrange(0, len(s) // 5)):
                s.discard(e)
            sets.append(s)
        bits = [odd_bits(np.array(sorted(s), dtype=np.uint64)) if rng.random() < 0.95 else None for s in sets]
        first = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    gap = 0 if bits[i] is None or bits[j] is None else odd_gap(bits[i], bits[j])
                    may = bits[i] is None or bits[j] is None or den * (len(a) + len(b) - gap) >= num * (len(a) + len(b) + gap)
                    if may and (None in (bits[i], bits[j]) or min(len(a), len(b)) * den >= num * max(len(a), len(b))):
                        first[i] = min(first[i], first[j])
        assert jaccard.may_link_tree(np.array([len(s) for s in sets]), bits, num, den).tolist() == first


@pytest.mark.parametrize(("num", "den"), [(90, 100), (4, 5)])
def test_groups_compared_in_a_task(num, den):
    rng = random.Random(den)
    for _ in range(20):
        pivot = set(rng.sample(range(10**6), 60))
        sets = []
        for _ in range(rng.randrange(1, 30)):
            s = set(rng.choice(sets) if sets and rng.random() < 0.7 else pivot)
            for e in rng.sample(sorted(s), rng.randrange(0, 8)):
                s.discard(e)
                if rng.random() < 0.7:
                    s.add(rng.randrange(10**6))
            sets.append(s)
        least = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if den * len(a & b) >= num * len(a | b):
                        least[i] = min(least[i], least[j])
        diffs = [np.array(sorted(s ^ pivot), dtype=np.int64) for s in sets]
        assert jaccard.linked_in_group(np.array([len(s) for s in sets]), diffs, num, den).tolist() == least


def test_plans_of_signatures_outlast_a_task():
    """Tasks of a process share them; a task alone took 10 seconds for those of its sets."""
    enum = part_enum(4, 5)
    assert part_enum(4, 5) is enum and enum.plan(30) is part_enum(4, 5).plan(30)
    for mean, n in ((0.0, 3), (0.4, 0), (7.5, 12), (300.0, 280), (2000.0, 900)):
        plain = 1 - sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(n + 1)) if mean else 0
        assert abs(_beyond(mean, n) - plain) < 1e-9
