"""Line dedup by overlapping three-line windows, and substring dedup by hashes of single lines or of sentences.

All cut a text at line feeds. A line is compared without blanks at its ends; blank lines are never compared or removed.
A document is its id and text: rows that repeat both are one document and get one result each. Documents of one id
but other texts are ordered by a hash of the text. The earliest occurrence is that of the least (id, text hash, line).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh, join_skewed, materialize, table

BLANKS = " \t\r"
#: A run of repeated sentences with fewer words in all is common speech ("Thank you.") and stays.
PASSAGE_WORDS = 15
#: A cut before and after each line feed, and after the mark and the blank that end a sentence.
SENTENCE_END = re.compile("\n|[.!?\u2026][ \t]|[\u3002\uff01\uff1f]")
RAGGED = re.compile("[\t\r]|  ")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _normal(x: Column) -> Column:
    return F.regexp_replace(F.translate(_bare(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\r]+", " ")


def _digest(*parts: Column) -> Column:
    """128 bits, for at 10**11 units two of 64 would meet by chance."""
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def _numbered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).filter(F.col("text").isNotNull())


def _later(units: DataFrame, name: str) -> DataFrame:
    """The rows of units (digest, id, h, at, ...) that aren't the earliest of their digest; adds first (id, h, at)."""
    place = F.struct("id", "h", "at")
    found = units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("occurrences"))
    found = materialize(found.filter("occurrences > 1"), name)
    total = units.count()
    later = join_skewed(units, found, "digest", "occurrences", total)
    return later.filter(place != F.col("first"))


def _kept(pieces: Column, gone: Column, sep: str) -> Column:
    """pieces, put together without those at the places `gone`; each is looked at once."""
    each = F.transform(F.array(pieces), lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone), lambda i: F.get(p, i)))
    return F.array_join(each[0], sep)


def _without(docs: DataFrame, removed: DataFrame, id_col: str, text: str, more: list[str]) -> DataFrame:
    """docs with the removed line numbers left out of text; adds n_lines, n_removed and the columns `more`."""
    named = [c for c in docs.columns if c not in ("n_lines", "n_removed", *more)]
    h, of_id, of_h, gone = fresh(named, "h", "id", "rh", "gone")
    keyed = docs.select(*[F.col(f"`{c}`") for c in named], F.xxhash64(text).alias(h))
    r = removed.select(F.col("id").alias(of_id), F.col("h").alias(of_h), F.col("gone").alias(gone), *more)
    out = keyed.join(r, F.col(f"`{id_col}`").eqNullSafe(F.col(of_id)) & (F.col(h) == F.col(of_h)), "left")
    lines = _lines(F.col(text))
    cols = [F.when(F.col(gone).isNotNull(), _kept(lines, F.col(gone), "\n")).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in named]
    return out.select(*cols, F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), *more)


def dedup_windows(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """docs without the lines of later occurrences of runs of `size` lines; adds n_lines and n_removed.

    Every run of consecutive non-blank lines is hashed. A line goes if it is in an occurrence of a run that isn't the
    earliest of that run anywhere, unless it is in the earliest one too (a line repeated over and over leaves
    its first run). Texts of fewer lines, empty and null texts stay. Columns of docs with those names are replaced.
    """
    marked = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), _bare(x).alias("x"))), lambda s: s["x"] != "")
    base = _numbered(docs, id_col, text).select("id", "h", marked.alias("m"))
    runs = F.transform(F.sequence(F.lit(1), F.size("m") - size + 1), lambda k: F.slice("m", k, size))
    runs = base.filter(F.size("m") >= size).select("id", "h", F.posexplode(runs).alias("at", "run"))
    units = runs.select(_digest(*[F.col("run")[j]["x"] for j in range(size)]).alias("digest"), "id", "h", "at", F.col("run.i").alias("lines"))
    units = materialize(units, "windows")
    later = _later(units, "repeated-windows")
    # `at` counts non-blank lines, as the first run's own lines do.
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    at = F.col("at") + F.col("k")
    hit = later.select("id", "h", "at", "first", F.posexplode("lines").alias("k", "line"))
    hit = hit.filter(~(same & (at >= F.col("first.at")) & (at < F.col("first.at") + size)))
    gone = hit.groupBy("id", "h").agg(F.collect_set("line").alias("gone"))  # lines of one document
    return _without(docs, gone, id_col, text, [])


def _words() -> Column:
    return F.when(F.col("bare") != "", F.length("bare") - F.length(F.replace("bare", F.lit(" "))) + 1).otherwise(0)


def _passages(later: DataFrame, min_words: int) -> DataFrame:
    """The repeats (id, h, at, words, ...) that stand in runs, by `at`, of at least min_words words; ids may be null."""
    island = F.col("at") - F.row_number().over(Window.partitionBy("id", "h").orderBy("at"))
    passage = Window.partitionBy("id", "h", "island")
    return later.withColumn("island", island).withColumn("total", F.sum("words").over(passage)).filter(F.col("total") >= min_words)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """docs without lines that stand earlier elsewhere; adds n_lines, n_removed and removed.

    The units are single lines, normalised (A-Z lower-cased, runs of blanks one space). A unit of which an
    earlier occurrence exists is a repeat and goes. With min_words above 1, only repeats go that follow each other with no
    other non-blank line between and have so many words in all. removed has (line, start, end) of each line that went, in code points of the original text. Empty and null texts stay.
    Columns of docs with those names are replaced.
    """
    line = F.posexplode(_lines(F.col("text"))).alias("line", "x")
    rows = _numbered(docs, id_col, text).select("id", "h", line)
    rows = rows.select("id", "h", "line", F.length("x").alias("chars"), _normal(F.col("x")).alias("bare"))
    rows = rows.select("id", "h", "line", "chars", _words().alias("words"), F.when(F.col("bare") != "", _digest(F.col("bare"))).alias("digest"))
    in_text = Window.partitionBy("id", "h").orderBy("line")
    start = F.coalesce(F.sum(F.col("chars") + 1).over(in_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.distinct().withColumn("start", start).filter(F.col("digest").isNotNull())
    rows = rows.withColumn("at", F.row_number().over(in_text))
    units = materialize(rows, "units")
    later = _later(units, "repeated-units").select("id", "h", "line", "at", "words", "start", "chars")
    long = _passages(later, min_words)
    span = F.struct("line", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("chars")).cast("long").alias("end"))
    gone = long.groupBy("id", "h").agg(F.collect_list("line").alias("gone"), F.array_sort(F.collect_list(span)).alias("removed"))
    return _without(docs, gone, id_col, text, ["removed"])


def sentences(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, line, normalised) of each sentence of a text that isn't blank, in code points."""
    low = text.encode().lower().decode()  # bytes: A-Z alone
    out, at, line = [], 0, 0

    def piece(end: int) -> None:
        bare = low[at:end].strip(BLANKS)
        if bare:
            out.append((at, end, line, " ".join(x for x in re.split("[ \t\r]+", bare)) if RAGGED.search(bare) else bare))

    for mark in SENTENCE_END.finditer(low):
        feed = mark.group() == "\n"
        piece(mark.start() if feed else mark.end())
        at, line = mark.end(), line + feed
    piece(len(low))
    return out


def without_passages(text: str, later: list[int], min_words: int) -> tuple[str, list[tuple[int, int]]]:
    """text without the runs of sentences (by number, ascending) that have min_words words or are all of it; and their spans.

    A line of which all sentences go, goes with its line feed.
    """
    units = sentences(text)
    gone, run = [], []
    for k in [*later, -1]:
        if run and k != run[-1] + 1:
            if len(run) == len(units) or sum(units[i][3].count(" ") + 1 for i in run) >= min_words:
                gone += run
            run = []
        run.append(k)
    in_line, gone_of = Counter(u[2] for u in units), Counter(units[i][2] for i in gone)
    kept, at = [], 0
    for i in gone:
        start, end, line, _ = units[i]
        if gone_of[line] == in_line[line]:
            start = text.rfind("\n", 0, start) + 1
            end = text.find("\n", end) + 1 or len(text)
        kept.append(text[at : max(at, start)])
        at = max(at, end)
    return "".join([*kept, text[at:]]), [units[i][:2] for i in gone]


def dedup_sentences(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs without passages of sentences that stand earlier elsewhere; adds n_units, n_removed and removed.

    The units are the sentences inside lines (a line end ends one too), normalised as in dedup_lines(), so a repeat that
    starts or ends inside a line, or has an edited sentence in it, loses its equal sentences. Repeats that follow each
    other with no other non-blank unit between make a passage, and one of at least min_words words goes. A text of which all units are repeats
    goes whole, however short. min_words = 1 removes every later occurrence: that is the dealt method; a larger one departs from it. n_units and n_removed count
    non-blank units. removed has (start, end) of each unit that went, in code points of the original text. The
    blank that ends a sentence goes with it, and a line goes with its line feed if all its units do. Empty and null texts stay;
    rows that repeat id and text lose the same. Columns of docs with the names of outputs are replaced.

    Tasks cut texts twice, once to hash the units and once to leave some out, so only a unit's digest, document and number move.
    """

    @F.arrow_udf("array<binary>")
    def digests(texts: pa.Array) -> pa.Array:
        return pa.array(([hashlib.md5(u[3].encode()).digest() for u in sentences(t.as_py())] for t in texts), type=pa.list_(pa.binary()))

    @F.arrow_udf("text string, n_units long, removed array<struct<start: long, end: long>>")
    def left(texts: pa.Array, later: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(texts, later, strict=True):
            t, k = t.as_py(), k.as_py()
            if not k:
                out.append({"text": None, "n_units": len(sentences(t)) if t is not None else 0, "removed": None})
                continue
            rest, spans = without_passages(t, k, min_words)
            out.append({"text": rest, "n_units": len(sentences(t)), "removed": [{"start": a, "end": b} for a, b in spans] or None})
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(out, type=pa.struct([("text", pa.string()), ("n_units", pa.int64()), ("removed", pa.list_(span))]))

    base = _numbered(docs, id_col, text)
    units = base.select("id", "h", F.posexplode(digests(F.col("text").cast("string"))).alias("at", "digest")).select("digest", "id", "h", "at")
    units = materialize(units, "units")
    lists = _later(units, "repeated-units").groupBy("id", "h").agg(F.array_sort(F.collect_set("at")).alias("later"))

    named = [c for c in docs.columns if c not in ("n_units", "n_removed", "removed")]
    h, of_id, of_h, later, made = fresh(named, "h", "id", "rh", "later", "made")
    keyed = docs.select(*[F.col(f"`{c}`") for c in named], F.xxhash64(text).alias(h))
    lists = lists.select(F.col("id").alias(of_id), F.col("h").alias(of_h), F.col("later").alias(later))
    out = keyed.join(lists, F.col(f"`{id_col}`").eqNullSafe(F.col(of_id)) & (F.col(h) == F.col(of_h)), "left")
    out = out.withColumn(made, left(F.col(f"`{text}`").cast("string"), F.col(later)))
    removed = F.col(made)["removed"]
    cols = [F.when(removed.isNotNull(), F.col(made)["text"]).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in named]
    return out.select(*cols, F.col(made)["n_units"].alias("n_units"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"), removed.alias("removed"))


def query_windows(spark, sf_dir: str) -> DataFrame:
    """op7: n_removed lines of each document, and the digest of what is left."""
    out = dedup_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def _spans(removed: str) -> Column:
    each = F.transform(removed, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return F.coalesce(F.array_join(each, ","), F.lit("")).alias("removed_spans")


def query_sentences(spark, sf_dir: str) -> DataFrame:
    """op10: n_removed sentences of each document, their offsets, and the digest of what is left."""
    out = dedup_sentences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "n_units", _spans("removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def query_lines(spark, sf_dir: str) -> DataFrame:
    """op10 by whole lines: every later occurrence of a line goes."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "n_lines", _spans("removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


_SQL_LINES = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i - 1 AS line, ls[i] AS x, trim(ls[i], ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
)"""

_SQL_REST = r"""
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, count(gone.line) AS n_removed, {more}
  sha256(CASE WHEN count(gone.line) = 0 THEN any_value(d.text) ELSE coalesce(string_agg(l.x, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL), '') END) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line GROUP BY d.doc_id, d.ls
"""

SQL_WINDOWS = (
    _SQL_LINES
    + r"""
, n AS (SELECT *, row_number() OVER w AS nr, lead(bare) OVER w AS b2, lead(bare, 2) OVER w AS b3, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM l WHERE bare <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
o AS (SELECT *, first_value(doc_id) OVER k AS fd, first_value(nr) OVER k AS fa FROM n WHERE b3 IS NOT NULL WINDOW k AS (PARTITION BY bare, b2, b3 ORDER BY doc_id, nr)),
c AS (SELECT doc_id, unnest([nr, nr + 1, nr + 2]) AS a, unnest([line, l2, l3]) AS line, fd, fa FROM o WHERE doc_id <> fd OR nr <> fa),
gone AS (SELECT DISTINCT doc_id, line FROM c WHERE NOT (doc_id = fd AND a >= fa AND a < fa + 3))
"""
    + _SQL_REST.format(more="")
)

SQL_LINES = (
    _SQL_LINES
    + r"""
, u AS (SELECT doc_id, line, length(x) AS chars, regexp_replace(translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r]+', ' ', 'g') AS g,
  coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
n AS (SELECT *, len(string_split(g, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nr, row_number() OVER (PARTITION BY g ORDER BY doc_id, line) AS nth FROM u WHERE g <> ''),
gone AS (SELECT doc_id, line, CAST(start AS BIGINT) AS start, CAST(start + chars AS BIGINT) AS stop FROM n WHERE nth > 1)
"""
    + _SQL_REST.format(more="coalesce(string_agg(gone.start || '-' || gone.stop, ',' ORDER BY gone.start), '') AS removed_spans,")
)

#: chr(57344) is a private character that stands for a cut.
SQL_SENTENCES = r"""
WITH d AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(replace(text, chr(10), chr(57344) || chr(10) || chr(57344)), '([.!?\x{2026}][ \t])', '\1' || chr(57344), 'g'), '([\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(57344), 'g'), chr(57344)) AS ps FROM documents),
p AS (SELECT doc_id, i, ps[i] AS x FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM d)),
q AS (SELECT *, CASE WHEN x = chr(10) THEN '' ELSE regexp_replace(translate(trim(x, ' ' || chr(9) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r]+', ' ', 'g') END AS g,
  coalesce(sum(length(x)) OVER w, 0) AS start, coalesce(sum(CASE WHEN x = chr(10) THEN 1 ELSE 0 END) OVER w, 0) AS line FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, len(string_split(g, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nr, count(*) OVER (PARTITION BY doc_id) AS n_units, count(*) OVER (PARTITION BY doc_id, line) AS in_line, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM q WHERE g <> ''),
r AS (SELECT *, nr - row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS island FROM u WHERE nth > 1),
s AS (SELECT doc_id, i, line, in_line, CAST(start AS BIGINT) AS start, CAST(start + length(x) AS BIGINT) AS stop FROM (SELECT *, sum(words) OVER k AS total, count(*) OVER k AS run FROM r WINDOW k AS (PARTITION BY doc_id, island)) WHERE total >= 15 OR run = n_units),
whole AS (SELECT doc_id, line FROM s GROUP BY doc_id, line, in_line HAVING count(*) = in_line),
kept AS (SELECT q.doc_id, string_agg(q.x, '' ORDER BY q.i) AS t FROM q LEFT JOIN s ON s.doc_id = q.doc_id AND s.i = q.i LEFT JOIN whole ON whole.doc_id = q.doc_id AND whole.line = q.line WHERE s.i IS NULL AND whole.line IS NULL GROUP BY q.doc_id),
n AS (SELECT doc_id, any_value(n_units) AS n_units FROM u GROUP BY doc_id), m AS (SELECT doc_id, count(*) AS n_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n_removed, 0) AS n_removed, coalesce(n.n_units, 0) AS n_units, coalesce(m.spans, '') AS removed_spans, sha256(CASE WHEN m.doc_id IS NULL THEN d.text ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
