"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every run of consecutive words of every item. Reading a document's words, it tracks the longest run
that ends at each word and is part of an item; where that reaches the window length (or a whole shorter item ends), the
words of the window are hit. Spans of hit words are cut out of the text, or the document goes, by length and coverage.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import materialize, table

#: A word is a run of digits, ASCII letters (lower-cased) and anything beyond ASCII; other bytes part words.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(rb"[^ ]+")

SCAN = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
SCAN_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "words", "start", "end")])))])


class Automaton:
    """Generalised suffix automaton over words; windows of `window` words, or whole items of fewer."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.ids = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        texts = [(item, [self.ids.setdefault(w, len(self.ids)) for w in text.translate(NORMAL).split()]) for item, text in items]
        texts = [(item, words) for item, words in texts if words]
        self.shortest = min([window, *(len(w) for _, w in texts)])
        for _, words in texts:
            last = 0
            for c in words:
                last = self._extend(last, c)
        self.items = [set() for _ in self.len]  # of the items that a state's runs are in
        self.whole: dict[int, list[tuple[int, str | None]]] = {}  # short items that are a run of the state
        for k, (item, words) in enumerate(texts):
            state = 0
            for c in words:
                state = self.next[state][c]
                up = state
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if len(words) < window:
                while self.len[self.link[state]] >= len(words):
                    state = self.link[state]
                self.whole.setdefault(state, []).append((len(words), item))
        names = [item for item, _ in texts]
        self.items = [frozenset(names[k] for k in s if names[k] is not None) for s in self.items]
        self.near_whole = [-1] * len(self.len)  # the closest state up the links, itself included, with a whole item
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near_whole[s] = s if s in self.whole else self.near_whole[self.link[s]]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        """The state of the run of `last` with c after it, made where there is none yet."""
        known = self.next[last].get(c)
        if known is not None:
            return known if self.len[known] == self.len[last] + 1 else self._clone(last, c, known)
        new, p = self._state({}, 0, self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        short = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = short
            p = self.link[p]
        self.link[q] = short
        return short

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [first word, end) of hit words, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        if not self.ids or len(words) < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.ids.get, words, iter(lambda: -1, None)), dtype=np.int64, count=len(words))
        # Only runs of words that the items have, as long as the shortest window, can hold one.
        known = np.flatnonzero(np.diff(np.concatenate([[0], ids >= 0, [0]])))
        for lo, hi in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if hi - lo >= self.shortest:
                self._run(ids[lo:hi].tolist(), lo, spans, found)
        return spans, found

    def _run(self, ids: list[int], at: int, spans: list[list[int]], found: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        v = n = 0
        for end, c in enumerate(ids, at + 1):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c not in nxt[v]:
                continue
            v, n = nxt[v][c], n + 1
            hit = 0
            if n >= window:
                s = v
                while length[link[s]] >= window:
                    s = link[s]
                found |= self.items[s]
                hit = window
            w = self.near_whole[v]
            while w > 0:
                for size, item in self.whole[w]:
                    if size <= n:
                        hit = max(hit, size)
                        if item is not None:
                            found.add(item)
                w = self.near_whole[link[w]]
            if hit:
                while spans and spans[-1][1] >= end - hit:
                    hit = max(hit, end - spans.pop()[0])
                spans.append([end - hit, end])


_built: dict[tuple[str, int], Automaton] = {}


def _automaton(shared, token: str, window: int) -> Automaton:
    key = (token, window)  # a worker outlives a broadcast, and an object's address may be used again
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(shared.value, window)
    return _built[key]


def _scan_udf(shared, window: int):
    """Text and what an earlier automaton found in it to a SCAN struct."""
    token = uuid.uuid4().hex

    @F.arrow_udf(SCAN)
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        machine, out = _automaton(shared, token, window), []
        for t, old in zip(text.cast(pa.binary()).to_pylist(), before.to_pylist(), strict=True):
            flat = (t or b"").translate(NORMAL)
            words = flat.split()
            spans, found = machine.scan(words)
            if old is not None:
                found |= set(old["items"])
                marks = sorted([*spans, *([s["first"], s["first"] + s["words"]] for s in old["spans"])])
                spans = []
                for a, b in marks:
                    if spans and spans[-1][1] >= a:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
            placed = []
            if spans:
                edges = [m.span() for m in WORD.finditer(flat)]
                points = np.concatenate([[0], np.cumsum((np.frombuffer(flat, dtype=np.uint8) & 0xC0) != 0x80)])
                placed = [{"first": a, "words": b - a, "start": int(points[edges[a][0]]), "end": int(points[edges[b - 1][1]])} for a, b in spans]
            out.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "items": sorted(found), "spans": placed})
        return pa.array(out, type=SCAN_ARROW)

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, automaton_bytes: int = 2_000_000, into: str = "scan") -> DataFrame:
    """docs and a struct, named by `into`: n_words, n_hit, items (ids as strings, sorted), spans of hit words.

    A span has its first word, its words, and its start and end in code points of the text. benchmark has
    item_id and text. It is broadcast in pieces of at most automaton_bytes of item text (a longer item is a piece); with
    more than one piece, docs are written to the shared folder after each, so a task holds one automaton at a time.

    A null or wordless text has no words, a null or wordless item no windows. A null item_id hits but isn't listed;
    items with one id are one item. Repeated rows are scanned each. A column of docs of that name is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pieces = max(1, -(-size // automaton_bytes))
    out = docs.withColumn(into, F.lit(None).cast(SCAN))
    for k in range(pieces):
        mine = items if pieces == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == k)
        rows = mine.select(F.col("item_id").cast("string"), F.encode("text", "UTF-8")).collect()  # about automaton_bytes
        shared = spark.sparkContext.broadcast(sorted(((r[0], bytes(r[1])) for r in rows), key=lambda r: (r[0] or "", r[1])))
        out = out.withColumn(into, _scan_udf(shared, window)("text", into))
        if k + 1 < pieces:
            out = materialize(out, "decontam")
    return out


def clean(scanned: DataFrame, *, min_span: int = 1, max_coverage: float = 1.0, found: str = "scan") -> DataFrame:
    """Cut out of the text of each scanned document the spans of at least min_span words.

    Documents of which more than the share max_coverage of the words is hit are dropped. What is left is
    joined by a space. The struct of scan() stays; with no span the text stays as it is.
    """
    kept = scanned.filter((F.col(f"{found}.n_hit") <= F.lit(max_coverage) * F.col(f"{found}.n_words")) | (F.col(f"{found}.n_hit") == 0))
    cuts = F.filter(f"{found}.spans", lambda s: s["words"] >= min_span)
    starts = F.concat(F.array(F.lit(0).cast("long")), cuts["end"])
    ends = F.concat(cuts["start"], F.array(F.length("text").cast("long")))
    parts = F.zip_with(starts, ends, lambda a, b: F.trim(F.substr("text", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))))
    return kept.withColumn("text", F.when(F.size(cuts) > 0, F.array_join(F.filter(parts, lambda p: p != ""), " ")).otherwise(F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: windows of 10 words."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "scan.n_words",
        "scan.n_hit",
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("scan.items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("scan.n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, s)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
