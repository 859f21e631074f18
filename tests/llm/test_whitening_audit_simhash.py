"""Whitening, filter audit and SimHash links: against brute force, and on hard rows."""

from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import audit, simhash, whitening
from tallyforge.llm.queries import QUERIES

CLASH = ("id", "x", "w", "n", "key", "part", "state", "bits", "first", "digest", "fp", "component", "whitened", "_h", "_id", "_gone", "_order", "_block", "_k", "_s", "_rank")


# 11


def _held_to_brute_force(rows, found, k=16):
    """rows: (vec_id, vector); found: vec_id -> component -> row of the query."""
    fine = {i: np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64) + 1_000_000 for i, v in rows if v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v)}
    fit = np.array(sorted({tuple(v) for v in fine.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    assert set(found) == set(fine)
    signs = {}
    for i, x in fine.items():
        assert sorted(found[i]) == list(range(1, min(k, fit.shape[1]) + 1))
        for c, r in found[i].items():
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
            assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
            want = (x - sums / n) @ vectors[:, c - 1] / np.sqrt(e[c - 1])
            if abs(want) > 1e-3:
                signs.setdefault(c, set()).add(np.sign(want) == np.sign(r["whitened"]))
            assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def _by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_op11_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    _held_to_brute_force(rows, _by_row(QUERIES["op11_svd_whitening"](spark, sf_dir)))


def test_op11_hard_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    rows += [(40 + i, rows[0][1]) for i in range(30)]  # one vector often
    bad = [(None, None), (90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf")] + [0.0] * 4), (94, [float("-inf")] * 5)]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(7)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(str(tmp_path / "embeddings.parquet"))
    _held_to_brute_force(rows, _by_row(QUERIES["op11_svd_whitening"](spark, str(tmp_path))))
    other = docs.union(spark.createDataFrame([(95, [1.0, 2.0]), (96, []), (97, [1e30] * 5)], "vec_id long, embedding array<float>").select("*", *[F.lit("mine") for _ in CLASH]))
    model = whitening.fit(other)
    assert model.n == 40 and len(model.sums) == 5
    out = whitening.whiten(other, model, into="_new")
    assert out.columns == [*docs.columns, "_new"] and out.count() == len(rows) + len(bad) + 3
    got = {r["vec_id"]: r for r in out.collect()}
    assert all(r[c] == "mine" for r in got.values() for c in CLASH)
    assert all(got[i]["_new"] is None for i in (None, 90, 91, 92, 93, 94, 95, 96, 97)) and got[41]["_new"] == got[0]["_new"]


def test_op11_flat_directions_one_row_and_no_rows(spark, tmp_path):
    flat = spark.createDataFrame([(i, [float(i), float(2 * i), 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    model = whitening.fit(flat)
    assert model.usable.tolist() == [True, False, False] and model.identity_error < 1e-9
    w = whitening.whiten(flat, model).select("whitened.values").collect()
    assert all(v[0][0] is not None and v[0][1:] == [None, None] for v in w)
    one = whitening.fit(flat.limit(1))
    assert one.n == 1 and one.identity_error is None and not one.usable.any()
    assert whitening.whiten(flat.limit(1), one).first()["whitened"]["values"] == [None] * 3
    flat.limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op11_svd_whitening"](spark, str(tmp_path)).collect() == []


def test_op11_merges_lose_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 2000, size=(300, 12)) * np.arange(1, 13) + 1_000_000
    held = None
    for part in np.array_split(x, [1, 4, 50, 51, 200]):
        held = whitening.summarize(part) if held is None else whitening.merge(held, whitening.summarize(part))
    n, sums, s, vt = held
    assert n == 300 and (sums == x.sum(axis=0)).all() and len(s) == 12
    c = x - x.mean(axis=0)
    assert np.allclose((vt.T * s**2) @ vt, c.T @ c, rtol=1e-10)


def test_op11_deviations_beyond_64_bits():
    model = whitening.Model(3_000_000_000, np.array([3_000_000_000 * 5, 7], dtype=np.int64), np.ones(2), np.eye(2), 2.0, 0.0)
    x = np.array([[5, 0], [6, 0], [5 + 10**10, 0]])
    exact = [sum((model.n * int(v) - int(s)) ** 2 for v, s in zip(r, model.sums, strict=True)) for r in x]
    assert whitening.deviations(model, x) == [v if v < 2**63 else None for v in exact]


# 12


def _audit_by_hand(docs, labels):
    texts, fails = {}, []
    for i, t, p in docs:
        texts.setdefault(t or "", []).append(i)
    for i, t, p in docs:
        t, p = t or "", p or ""
        w = [x for x in t.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x]
        smaller = i is not None and any(j is not None and j < i for j in texts[t])
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": smaller}
        good, toxic = (any(x[k] == 1 for x in labels if i is not None and x[0] == i) for k in (1, 2))
        fails.append((p, f, good, toxic))
    out, shapley = {}, Counter()
    for p in {x[0] for x in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[0] == p]
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                failing = [x for x in fails if x[0] == p and x[1][letter]]
                out[p, order, step] = [len(left), len(gone), len(failing) - len(gone) - sum(1 for x in left if x[1][letter]), sum(sum(x[1].values()) == 1 for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[p, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_op12_hard_rows_by_hand(spark, tmp_path):
    many = " ".join(f"w{i}" for i in range(120))
    docs = [(0, None, None), (1, "", ""), (2, many, "en"), (3, many, "en"), (3, many, "en"), (4, many, "de"), (None, many, "en"), (None, None, None), (5, "A" * 9 + " \v é|" * 30, "en"), (6, many + " #", "x"), (7, "la " * 20_000, "de"), (8, "\x00\t" + many + " ", None), (9, many.upper(), "en"), (10, many, None)]
    labels = [(2, 1, 0), (2, None, 1), (3, 1, 1), (None, 1, 1), (10, 0, 1), (6, 1, None), (77, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for c in CLASH:
        d = d.withColumn(c, F.lit("mine"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("mine")).write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in QUERIES["op12_filter_audit"](spark, str(tmp_path)).collect()}
    assert got == _audit_by_hand(docs, labels)


def test_op12_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.report(audit.prefix_counts(audit.judged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))).collect() == []


def test_op12_bitsets_count_as_sets_do():
    rng = np.random.default_rng(2)
    part, state = rng.integers(0, 5, 3000), rng.integers(0, 128, 3000)
    part[part == 3] = 4  # a part without rows in this batch can't be: parts come from the rows
    part[part == 4] -= 1
    got = audit.subset_counts(part, state, 4, 5)
    for p in range(4):
        for chosen in range(32):
            kept = (part == p) & (state & chosen == 0)
            assert got[p, chosen].tolist() == [kept.sum(), (kept & (state & 32 > 0)).sum(), (kept & (state & 64 > 0)).sum()]


# 13


def _fingerprint(text, words=3):
    w = [x for x in (text or "").translate({**dict.fromkeys(range(9, 14), " "), **{c: c + 32 for c in range(65, 91)}}).split(" ") if x]
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def _components(prints, ids, most=3):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if bin(p ^ q).count("1") <= most:
                root[find(p)] = find(q)
    least = {}
    for p, i in zip(prints, ids, strict=True):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


def test_op13_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [_fingerprint(t) for _, t in rows]
    want = {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, _components(prints, [i for i, _ in rows]), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op13_simhash_pivots"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("group", [512, 8], ids=["at once", "dealt anew"])
def test_op13_hard_rows(spark, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(None, None), (5, None), (4, ""), (6, " \t\n\v"), (7, "One two"), (8, "oNE\ntwo"), (9, "é   z ÄÖ"), (10, " ".join(base)), (10, " ".join(base)), (11, " ".join(base * 200)), (None, "only here and nowhere else at all")]
    for k in range(60):
        near = list(base)
        for _ in range(k % 7):
            near[rng.randrange(300)] = f"x{rng.randrange(99)}"
        rows.append((100 - k if k % 9 else None, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("mine"))
    prints = [_fingerprint(t) for _, t in rows]
    want = Counter((i, p, c) for (i, _), p, c in zip(rows, prints, _components(prints, [i for i, _ in rows]), strict=True))
    assert Counter((r["id"], r["fp"] % 2**64, r["component"]) for r in simhash.link(docs).collect()) == want
    assert simhash.link(docs.limit(0)).collect() == []


@pytest.mark.parametrize("group", [512, 8])
def test_op13_links_of_random_chains(spark, group, monkeypatch):
    """Fingerprints a few bits apart, in chains and balls: the ties make the components of all close pairs."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng, prints = random.Random(group), set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(60):
            prints.add(p)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 4, 9])):
                p ^= 1 << b
    ball = rng.getrandbits(64)
    prints |= {ball ^ sum(1 << b for b in rng.sample(range(0, 64, 3), rng.randrange(6))) for _ in range(400)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    ties = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in ties:
        assert a != b
        root[find(a)] = find(b)
    got = Counter(find(p) for p in signed)
    assert sorted(got.values()) == sorted(Counter(_components(prints, prints)).values())


def test_op13_coordinates_tell_blocks_apart():
    """Distances within a block settle its bits: the references have full rank there, at every step of dealing."""
    todo, seen = [(1 << 64) - 1], set()
    for bits in todo:
        for block in simhash.blocks(bits, 4):
            at = [i for i in range(64) if block >> i & 1]
            signs = np.array([[1 - 2 * (int(p) >> i & 1) for i in at] for p in simhash.PIVOTS])
            assert np.linalg.matrix_rank(signs) == len(at)
            left = bits & ~block
            if bin(left).count("1") > 36 and left not in seen:
                seen.add(left)
                todo.append(left)
