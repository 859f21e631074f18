"""The stages of the corpus pipeline, each against a brute-force version of what it must do."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as cp
import pytest

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _tokens(text):
    return WORD.findall((text or "").encode().lower())


def _windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        after = cp.materialize(stage(spark, docs, sf_dir), name)
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_all_but_the_last_keep_the_columns(staged, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [c for _, _, c in staged.values()] == [columns] * 4 + [[*columns, "shard", "slot"]]


def test_language_id_keeps_prose(staged):
    before, after, _ = staged["language_id"]
    kept = {r["doc_id"] for r in after}
    prose = [r for r in before if r["lang"] is not None and len((r["text"] or "").split()) >= 20]
    assert sum(r["doc_id"] in kept for r in prose) >= 0.97 * len(prose)
    assert all(r["text"] for r in after)


def test_one_of_each_group_of_near_copies_stays(staged):
    before, after, _ = staged["near_duplicates"]

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r["doc_id"] for r in after) == [i for i in ids if find(i) == i]


def test_decontamination_takes_what_has_a_window_and_nothing_else(staged, spark, sf_dir):
    before, after, _ = staged["decontamination"]
    items = [_tokens(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {w for t in items if t for w in _windows(t, min(10, len(t)))}
    sizes = {len(w) for w in held}
    clean = [r["doc_id"] for r in before if not any(_windows(_tokens(r["text"]), n) & held for n in sizes)]
    assert sorted(r["doc_id"] for r in after) == sorted(clean) and len(clean) < len(before)


def test_mixing_repeats_whole_rows_near_the_targets(staged):
    before, after, _ = staged["mixing"]
    copies = Counter(after)
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    longest = max(words([r]) for r in before)
    sources = sorted({r["source"] for r in before if r["source"] is not None}) + [None]
    sizes = {s: words([r for r in before if r["source"] == s]) for s in sources}
    goal = cp.mixing.targets({s: n for s, n in sizes.items() if n})
    for s, want in goal.items():
        assert abs(words([r for r in after if r["source"] == s]) - want) <= longest


def test_sharding_moves_every_row_once(staged):
    before, after, columns = staged["sharding"]
    assert Counter(tuple(r)[: len(columns) - 2] for r in after) == Counter(map(tuple, before))
    sizes = Counter(r["shard"] for r in after)
    assert max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "some words of text here", "en", "s", 23)]], ids=["empty", "hard"])
def test_stages_take_any_rows(rows, spark, sf_dir):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() <= 2 * len(rows)


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert rows and {"shard", "slot"} <= set(rows[0].asDict())


def test_texts_reach_python_in_small_batches(spark, sf_dir, monkeypatch):
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", []

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    def stage(spark, docs, sf_dir):
        many = docs.select("text").limit(200).selectExpr("repeat(text, 200) AS text").coalesce(1)
        most.extend(r["size"] for r in many.mapInArrow(sizes, "size long").collect())
        return docs

    monkeypatch.setattr(cp, "STAGES", [("one", stage), ("last", stage)])
    before = spark.conf.get(name, None)
    cp.run(spark, sf_dir)
    assert len(most) > 4 and sorted(most)[len(most) // 2] < 12 << 20  # one batch each before
    assert spark.conf.get(name, None) == before


def test_batches_of_signatures_take_little_memory():
    """The check's failure: each worker kept what its largest batch of signatures once took, four times in an executor."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from tallyforge.llm import jaccard

    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 5000, 200)).encode() for _ in range(2500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[at : at + 100])], ["text"]) for at in range(0, len(texts), 100)]
    rows = sum(b.num_rows for b in jaccard._signed(batches, 5, 4, 5))  # the plans of these sizes are there after that
    tracemalloc.start()
    assert sum(b.num_rows for b in jaccard._signed(batches, 5, 4, 5)) == rows > 300_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12e6


def test_stages_bind_their_own_batches(spark, sf_dir, monkeypatch):
    """The check's failure: only run() bound the batches of texts, the stages by themselves took 10,000 rows at once."""
    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for module, step in ((cp.jaccard, "signatures"), (cp.jaccard, "shingle_classes"), (cp.langid, "fit")):
        monkeypatch.setattr(module, step, lambda *a, f=getattr(module, step), **b: seen.append([spark.conf.get(n) for n in names]) or f(*a, **b))
    before = [spark.conf.get(n) for n in names]
    for _, stage in cp.STAGES[:2]:
        stage(spark, docs, sf_dir)
    assert len(seen) == 3 and seen == [["1m", "512"]] * 3
    assert [spark.conf.get(n) for n in names] == before


def test_no_task_of_near_duplicates_holds_two_workers(spark, sf_dir, monkeypatch):
    """A join by a column that Python makes had it made twice in a task, so each executor kept twice as many workers."""
    docs, plans = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    write = cp.jaccard.materialize
    monkeypatch.setattr(cp.jaccard, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython"))) or write(df, name))
    cp.near_duplicates(spark, docs, sf_dir)
    assert len(plans) > 10 and [(name, n) for name, n in plans if n > 1] == []


def test_a_worker_gives_back_what_arrow_keeps(monkeypatch):
    """Workers kept what Arrow's pool took, for nothing asked it to let go."""
    import pyarrow as pa
    from tallyforge.llm import jaccard

    held = []
    monkeypatch.setattr(jaccard, "give_back", lambda: held.append(pa.total_allocated_bytes()))
    start = pa.total_allocated_bytes()
    batches = (pa.RecordBatch.from_arrays([pa.array([f"some words of text {k} {i} " * 200 for i in range(500)])], ["text"]) for k in range(4))
    for _ in jaccard._signed(batches, 5, 4, 5):
        pass
    assert len(held) >= 4 and max(held) - start < 1e6  # the batch is gone by then; it is of 2 MB and more
