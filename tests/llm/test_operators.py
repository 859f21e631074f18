"""The corpus operators: against SQL, brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat, decontam, fingerprints, jaccard, langid, lines, mixing, sharding, warc
from tallyforge.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rng, n):
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def small_dir(tmp_path_factory):
    """Nulls, blanks, a long text, copies, near copies, repeated lines, test passages, odd characters."""
    rng, folder = random.Random(5), tmp_path_factory.mktemp("small")
    item = _words(rng, 30)
    base, para = _words(rng, 200), "\n".join(" ".join(_words(rng, 20)) for _ in range(4))
    texts = [None, "", " \t\n", "one", "One  two", "ÄÖ é \U0001f600 z", "a\r\n\n b \n", " ".join(base), " ".join(base).upper()]
    for k in range(12):
        near = list(base)
        near[rng.randrange(200)] = f"x{k}"
        texts.append(" ".join(near))
    texts += [para, "start\n" + para + "\nend", para + "\n" + para, " ".join(_words(rng, 5) + item[3:18] + _words(rng, 5)), " ".join(item[:9]), "tiny item here"]
    texts += [" ".join(_words(rng, 30_000)), "same line\n" * 50, "same line\n" * 50, para]
    n = len(texts)
    docs = {"doc_id": range(n), "text": texts, "lang": [None if i % 5 == 0 else "en" for i in range(n)], "source": [None if i % 7 == 0 else "é" if i % 3 else "a" for i in range(n)], "n_chars": [None] * n, "id": ["clash"] * n, "size": [1] * n}
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(), "id": pa.string(), "size": pa.int32()}
    pq.write_table(pa.table({k: pa.array(list(v), kinds[k]) for k, v in docs.items()}), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([2, 10, 3, 4], pa.int64()), "text": pa.array([" ".join(item), "Tiny, item!", None, ""], pa.string())}), folder / "benchmark.parquet")
    turns = [(1, 0, "user", None), (1, 1, "assistant", "</s>\\ <|im_end|>\n"), (2, 0, None, "x"), (2, 0, "assistant", ""), (3, None, "assistant", "\\n"), (3, None, "assistant", "\\n")]
    pq.write_table(pa.table({c: pa.array([t[i] for t in turns], k) for i, (c, k) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])}), folder / "conversations.parquet")
    pages = [(1, None), (2, ""), (3, "<p>é\U0001f600</p>"), (4, "<p>é\U0001f600</p>"), (9, "<p>é\U0001f600</p>"), (7, "x" * 70_000), (8, "\r\n\r\nWARC/1.0\r\n")]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([None, "", "u", "v", "u", "w", "x"]), "html": pa.array([p[1] for p in pages], pa.string())}), folder / "pages.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([3, 3, None, 8, 9, 99], pa.int64()), "quality": pa.array([1, None, 1, 0, 1, 1], pa.int32()), "toxic": pa.array([None, 1, 1, 1, 0, 0], pa.int32())}), folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql_on_hard_rows(name, spark, small_dir, same_as_sql):
    same_as_sql(QUERIES[name](spark, small_dir), SQL[name], small_dir)


HARD = [(None, None, None, None, None), (1, None, None, None, 3), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "a b c", "en", None, 5), (2, "", "xx", "s", 0), (3, "x\n" * 9, None, "t", 18)]
ROWWISE = {
    "fingerprints": lambda d, b: fingerprints.with_next(d, columns=["text"]).withColumn("fp", fingerprints.fingerprint(F.col("text"))),
    "sharding": lambda d, b: sharding.shard(d, 3),
    "langid": lambda d, b: langid.identify(d, langid.fit(d)),
    "mixing": lambda d, b: mixing.mix(d),
    "decontam": lambda d, b: decontam.scan(d, b),
    "windows": lambda d, b: lines.dedup_windows(d),
    "jaccard": lambda d, b: jaccard.link(d),
    "lines": lambda d, b: lines.dedup_lines(d),
}


#: Names that operators use for columns of their own, plain and hidden, but for those that a docstring says are replaced.
CLASHING = ("id", "h", "n", "key", "copies_", "block", "line", "_h", "_id", "_gone", "_rh", "_order", "_place", "_block", "_own", "_wrap", "_k", "_s", "_n", "_size", "_copies", "_rank", "_H")


@pytest.mark.parametrize("name", [*sorted(ROWWISE), "sentences", "keep_one", "repeat_copies"])
@pytest.mark.parametrize("rows", [HARD, []], ids=["hard", "empty"])
def test_nulls_repeats_clashes_and_no_rows(name, rows, spark):
    """Columns of the caller come back with their values, whatever their names."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame(rows, DOCS)
        for i, c in enumerate(CLASHING):
            docs = docs.withColumn(c, F.lit(f"mine {i}"))
        items = spark.createDataFrame([(None, "a b c"), (7, None)], "item_id long, text string")
        more = {"sentences": lambda d, b: lines.dedup_sentences(d), "keep_one": lambda d, b: jaccard.keep_one(d), "repeat_copies": lambda d, b: mixing.repeat_copies(mixing.mix(d), d.columns)}
        out = (ROWWISE | more)[name](docs, items)
        got = out.collect()
        if name not in more:
            assert len(got) == len(rows)
        if name != "jaccard":  # link() returns its own columns alone
            assert all(r[c] == f"mine {i}" for r in got for i, c in enumerate(CLASHING))
            kept = Counter((r["doc_id"], r["lang"], r["source"]) for r in got)
            assert name in more or kept == Counter((r[0], r[2], r[3]) for r in rows)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_hundreds_of_thousands_of_lines_in_one_text(spark):
    """Twice the same text of 200,000 lines: what goes is found in one walk over the lines."""
    text = "\n".join(f"line {i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id long, text string")
    for dedup in (lines.dedup_lines, lines.dedup_windows, lines.dedup_sentences):
        start = time.monotonic()
        got = {r["doc_id"]: r["text"] for r in dedup(docs).select("doc_id", "text").collect()}
        assert got == {1: text, 2: "last"} and time.monotonic() - start < 60


# 1


def _paragraphs(text):
    return Counter(p.strip(" ") for p in text.replace("\r", "\n").split("\n") if p.strip(" "))


@pytest.mark.parametrize("which", ["sf", "small"])
def test_op1_brute_force(which, spark, sf_dir, small_dir):
    folder = sf_dir if which == "sf" else small_dir
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op1_multiset_fingerprints"](spark, folder).collect()}
    assert len(got) == len(rows)
    by_print: dict[str, object] = {}
    for i, (doc, text) in enumerate(rows):
        r, after = got[doc], rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        if text == after:
            assert r["near_next"] == 1
        for fp, t in ((r["fingerprint"], text), (r["edited_fingerprint"], edited)):
            assert by_print.setdefault(fp[: 8 * fingerprints.IDENTITY], _paragraphs(t)) == _paragraphs(t)
    assert len(by_print) == len({tuple(sorted(_paragraphs(t).items())) for _, t in rows} | {tuple(sorted(m.items())) for m in by_print.values()})


def test_op1_is_homomorphic(spark):
    t = spark.createDataFrame([("a. b\nc\nc", "d; e\nf", "f\nc\nd; e\na. b\nc", "a. b\nc")], "a string, b string, ab string, other string")
    fp = {c: fingerprints.fingerprint(F.col(c)) for c in t.columns}
    r = t.select(
        (fingerprints.insert(fp["a"], fp["b"]) == fp["ab"]).alias("insert"),
        (fingerprints.delete(fp["ab"], fp["b"]) == fp["a"]).alias("delete"),
        (fp["a"] != fp["other"]).alias("times"),
    ).first()
    assert all(r)


# 2


def test_op2_is_a_whole_balanced_shuffle(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_hypergeometric_sharding"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots: dict[int, list[int]] = {s: [] for s in range(8)}
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2_matrix_has_the_right_margins_and_means():
    counts, sizes = np.array([7, 0, 40, 13, 3]), np.array([20, 21, 22])
    total = np.zeros((5, 3))
    for seed in range(400):
        m = np.stack([sharding.matrix_row(counts, sizes, p, seed) for p in range(5)])
        assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 400 - np.outer(counts, sizes) / 63).max() < 0.5
    rng = np.random.default_rng(1)
    big = [sharding._hypergeometric(rng, 4 * 10**9, 6 * 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(big) - 400) < 5


# 3


def test_op3_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_language_centroids"](spark, folder).collect()
    assert len(rows) == len(truth)
    judged = [r for r in rows if r["held_out"] and truth[r["doc_id"]]["lang"] is not None and langid.has_letter(truth[r["doc_id"]]["text"])]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in judged)
    assert len(judged) > 100 and right / len(judged) >= 0.95
    for r in rows:
        if not langid.has_letter(truth[r["doc_id"]]["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def test_op3_rejects_what_is_no_language(spark, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rng = random.Random(1)
    junk = " ".join("".join(rng.choice("qxzjkvw") for _ in range(9)) for _ in range(400))
    assert not langid.identify(spark.createDataFrame([(junk,)], "text string"), model).first()["language"]["accepted"]


# 4


@pytest.mark.parametrize("which", ["sf", "small"])
def test_op4_comes_near_its_targets(which, spark, sf_dir, small_dir):
    import re

    folder = sf_dir if which == "sf" else small_dir
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op4_pivotal_mixing"](spark, folder).collect()
    again = QUERIES["op4_pivotal_mixing"](spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(docs)
    by: dict = {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(d["source"], {"size": 0, "taken": 0, "most": 0, "target": r["target"], "source_size": r["source_size"]})
        s["size"], s["taken"], s["most"] = s["size"] + r["size"], s["taken"] + r["taken"], max(s["most"], r["size"])
    for s in by.values():
        assert s["size"] == s["source_size"] and s["target"] <= 2 * s["size"] + 1e-6
        assert abs(s["taken"] - s["target"]) <= s["most"]
    total = sum(s["size"] for s in by.values())
    assert sum(s["target"] for s in by.values()) == pytest.approx(min(1.5 * total, 2 * total))


def test_op4_targets_reshare_the_excess():
    got = mixing.targets({"b": 10, "a": 1000, None: 100})
    assert got["b"] == 20 and got[None] == 200 and got["a"] == pytest.approx(1.5 * 1110 - 220)


def test_op4_copies_have_the_right_mean(spark):
    rows = spark.createDataFrame([(0, i, 1 + i % 7, 0.3) for i in range(60)], "source_no int, uid long, size long, p double")
    ups = [sum(r["up"] * (1 + r["uid"] % 7) for r in mixing.pivotal(rows, seed=s, bucket_rows=20, fan_in=2).collect()) for s in range(6)]
    want = 0.3 * sum(1 + i % 7 for i in range(60))
    assert all(abs(u - want) <= 7 for u in ups)


# 5


def _digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_op5_brute_force(spark, sf_dir):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    owner: dict[bytes, int] = {}
    for page, payload in pages:
        owner[payload] = max(page, owner.get(payload, page))
    want = {(p, len(b), _digest(b), "response" if owner[b] == p else "revisit", None if owner[b] == p else owner[b]) for p, b in pages}
    got = QUERIES["op5_warc_archive"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert set(map(tuple, got)) == want and len(got) == len(pages)


def test_op5_round_trip_and_odd_pages(spark, tmp_path):
    rows = [(1, "u\r\nx", "same"), (2, None, "same"), (2, None, "same"), (None, "u", None), (3, "u", ""), (4, "u", "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert warc.read_payloads(spark, path).count() == 3
    found = warc.records(spark, path).collect()
    assert len(found) == len(rows)
    blocks = Counter()
    for r in found:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert rest[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        if b"WARC-Type: response" in head:
            assert ("sha1:" + _digest(rest[:length])).encode() in head
            blocks[rest[:length]] += 1
    assert blocks == {b"same": 1, b"": 1, ("é" * 5000).encode(): 1}
    empty = str(tmp_path / "none")
    warc.write_archive(pages.limit(0), empty)
    assert warc.records(spark, empty).count() == 0


# 6


def test_op6_cuts_spans_by_length_and_coverage(spark):
    docs = spark.createDataFrame([(1, "Before, one two THREE four! after"), (2, "one two three four"), (3, "clean text"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    found = decontam.scan(docs, items, window=4)
    cut = {r["doc_id"]: r["text"] for r in decontam.clean(found, max_coverage=0.9).collect()}
    assert cut == {1: "Before, ! after", 3: "clean text", 4: None}
    kept = {r["doc_id"]: r["text"] for r in decontam.clean(found, min_span=5).collect()}
    assert kept[2] == "one two three four"


def test_op6_in_pieces_is_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, many = (sorted((r["doc_id"], r["scan"]) for r in decontam.scan(docs, items, automaton_bytes=b).collect()) for b in (1 << 30, 5000))
    assert one == many


# 8


def _components(sets, num, den):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def _shingles(text, words):
    w = (text or "").split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


@pytest.mark.parametrize(("words", "num", "den"), [(5, 4, 5), (2, 1, 2)])
def test_op8_brute_force_on_chains_of_near_copies(words, num, den, spark):
    rng, texts = random.Random(3), []
    for _ in range(6):
        t = _words(rng, rng.choice([3, 12, 60, 150]))
        for _ in range(25):  # each a little farther from the first
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(t)
            texts.append(" ".join(t))
    texts += ["", None, "a", "a"]
    want = _components([_shingles(t, words) for t in texts], num, den)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in jaccard.link(docs, words=words, num=num, den=den).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(docs, words=words, num=num, den=den).collect())
    assert kept == sorted(set(want))


# 9


def test_op9_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", "he"), (1, 3, "delta", 2, None, "llo"), (1, 4, "message", 3, "user", "no"),
        (1, 5, "regenerate", 2, None, "he"), (1, 6, "delta", 2, None, "y"), (1, 7, "message", 4, "user", "ok"), (1, 8, "edit", 1, None, "hi!"), (2, 1, "delta", 1, "assistant", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = sorted(map(tuple, chat.fold(events).collect()))
    assert got == [(1, 1, "user", "hi!"), (1, 2, "assistant", "hey"), (1, 4, "user", "ok"), (2, 1, "assistant", "")]
    assert chat.read_back(chat.render(chat.fold(events.limit(0)))).count() == 0


def test_op9_escapes_are_reversible(spark):
    rng = random.Random(4)
    bits = [*chat.CHATML.controls, "\\", "\\n", "\n", "<", "|", "s>", "é", "\U0001f600", " "]
    turns = [(c, t, rng.choice(["user", "assistant", "a\\n\nb", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(40) for t in range(5)]
    back = chat.read_back(chat.render(spark.createDataFrame(turns, "conv_id long, message long, role string, text string"))).collect()
    for r in back:
        mine = [t for t in turns if t[0] == r["conv_id"]]
        assert [tuple(x) for x in r["turns"]] == [t[2:] for t in mine]
        assert r["loss_text"] == "".join(t[3] for t in mine if t[2] == "assistant")
        assert r["formatted"].count(chat.CHATML.open) == 5


# 7 and 10


def test_op7_merges_windows_and_keeps_the_first(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\nb\n\nc\nd\ny"), (3, "b\nc"), (4, "z\n" * 6)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_windows(docs).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x\n\ny", 3: "b\nc", 4: "z\nz\nz\n"}


def test_op10_offsets_are_of_the_original(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"é\n{passage}\nend"), (2, f"é\n  {passage.upper()}\nmore")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 2
    text = f"é\n  {passage.upper()}\nmore"
    assert [text[s["start"] : s["end"]] for s in got[2]["removed"]] == ["é", "  " + passage.upper()]
    assert got[2]["text"] == "more"
