"""op10 by sentences: repeats that start or end inside a line, and what is left of a text."""

from __future__ import annotations

import re

from tallyforge.llm import lines
from tallyforge.llm.queries import QUERIES

KINDS = "doc_id long, text string"


def _sentences(first, n=6):
    return " ".join(f"W{first} " + " ".join(f"w{first}x{i}x{j}" for j in range(11)) + "." for i in range(n))


def test_a_passage_inside_lines_goes_with_its_offsets(spark):
    shared = _sentences(1)
    texts = {1: f"é Own start. {shared} Own end.\nlast", 2: f"Other start here. {shared.upper()} Other end.\n{shared}\nmore", 3: None, 4: ""}
    docs = spark.createDataFrame(list(texts.items()), KINDS)
    assert all(r["n_removed"] == 0 for r in lines.dedup_lines(docs).collect())
    got = {r["doc_id"]: r for r in lines.dedup_sentences(docs).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 12, 0, 0]
    assert {i: got[i]["text"] for i in (1, 3, 4)} == {i: texts[i] for i in (1, 3, 4)}
    assert got[2]["text"] == "Other start here. Other end.\nmore"
    cut = [texts[2][s["start"] : s["end"]] for s in got[2]["removed"]]
    assert "".join(cut) == shared.upper() + " " + shared


def _units(text):
    out, at = [], 0
    for x in re.split(r"(?<=\n)|(?=\n)|(?<=[.!?…][ \t])|(?<=[。！？])", text):
        g = re.sub(r"[ \t\r]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\r\n"))
        if g:
            out.append((g, at, at + len(x)))
        at += len(x)
    return out


def _expected(texts, least):
    """Spans of the repeats in runs of at least `least` words, or of a whole text."""
    seen, out = set(), {}
    for doc in sorted(texts):
        run, gone = [], []
        for g, start, end in [*_units(texts[doc] or ""), (None, 0, 0)]:
            if g in seen:
                run.append((g, start, end))
                continue
            if sum(len(r[0].split(" ")) for r in run) >= least or len(run) == len(_units(texts[doc] or "")):
                gone += run
            run = []
            seen.add(g)
        out[doc] = ",".join(f"{s}-{e}" for _, s, e in gone)
        seen.discard(None)
    return out


def test_query_is_as_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op10_sentence_hashes"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["removed_spans"] for r in got} == _expected(texts, lines.PASSAGE_WORDS)
    assert sum(r["n_removed"] for r in got) > 0
    assert all(r["n_units"] == len(_units(texts[r["doc_id"]] or "")) for r in got)


def test_nulls_repeats_clashes_and_no_rows(spark):
    rows = [(None, None), (1, None), (1, "a b c"), (1, "a b c"), (None, "a b c"), (2, ""), (3, "x\n" * 9)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, KINDS)
        for c in ("n_units", "removed", "line"):
            docs = docs.selectExpr("*", f"'clash' as {c}")
        assert len(lines.dedup_sentences(docs).collect()) == len(some)


def test_short_whole_copies_go_and_every_repeat_on_demand(spark):
    rows = [(1, "Stock line.\nA short text."), (2, "stock line.\nA  SHORT text."), (3, "Stock line.\nOther words.")]
    docs = spark.createDataFrame(rows, KINDS)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_sentences(docs).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1]}
    got = {r["doc_id"]: r["text"] for r in lines.dedup_sentences(docs, min_words=1).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "Other words."}
