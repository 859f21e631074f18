"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions only.

A text is a multiset of paragraphs (its non-empty lines, trimmed). Each paragraph is hashed to a wide vector and
the vectors are summed lane by lane modulo powers of two, so the order of paragraphs doesn't matter and
a paragraph is inserted or deleted by adding or subtracting its vector. The vector has two parts:

* IDENTITY lanes modulo 2**32, hashed from the paragraph's SHA-256: equal sums mean equal multisets;
* SKETCH lanes modulo 2**32 that count, over the paragraph's clauses, the set bits of their hashes. The counts minus half
  the number of clauses are a random projection of the multiset of clauses, so the cosine of two such
  vectors estimates the cosine of the two multisets.

A fingerprint is an array of longs: IDENTITY lanes, two sketch lanes in each of SKETCH / 2 longs, the number of clauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh, row_hash, table

IDENTITY = 32
SKETCH = 128
LANE = (1 << 32) - 1
PAIR = (1 << 32) | 1
#: Keeps both halves of a long of two lanes apart; a lane never reaches 2**31, for a text has fewer bytes.
SPLIT = r"[.,;:!?|]+\s*"


def _add(a: Column, b: Column, sign: int = 1) -> Column:
    """Sum of two fingerprints lane by lane, modulo 2**32."""

    def lanes(x: Column, y: Column, i: Column) -> Column:
        low = (x.bitwiseAND(F.lit(LANE)) + F.lit(sign) * y.bitwiseAND(F.lit(LANE))).bitwiseAND(F.lit(LANE))
        high = (F.shiftrightunsigned(x, 32) + F.lit(sign) * F.shiftrightunsigned(y, 32)).bitwiseAND(F.lit(LANE))
        return F.when((i >= IDENTITY) & (i < IDENTITY + SKETCH // 2), F.shiftleft(high, 32).bitwiseOR(low)).otherwise(low)

    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    return F.transform(pairs, lambda p, i: lanes(p["x"], p["y"], i))


def insert(fingerprint: Column, part: Column) -> Column:
    """The fingerprint of a text with the paragraphs of another fingerprint added."""
    return _add(fingerprint, part)


def delete(fingerprint: Column, part: Column) -> Column:
    """The fingerprint of a text with the paragraphs of another fingerprint taken out."""
    return _add(fingerprint, part, -1)


def _sum_identity(paragraphs: Column) -> Column:
    zero = F.array_repeat(F.lit(0).cast("long"), IDENTITY)
    digests = F.transform(paragraphs, lambda p: F.sha2(p, 256))
    lanes = F.sequence(F.lit(0), F.lit(IDENTITY - 1))
    return F.aggregate(digests, zero, lambda acc, d: F.zip_with(acc, lanes, lambda a, i: (a + F.xxhash64(d, i).bitwiseAND(F.lit(LANE))).bitwiseAND(F.lit(LANE))))


def _sum_sketch(clauses: Column) -> Column:
    """Packed lanes: the j-th long of a hash counts its bits j and j + 32."""

    def half(seed: int) -> Column:
        hashes = F.transform(clauses, lambda c: F.xxhash64(F.lit(seed), c))
        zero = F.array_repeat(F.lit(0).cast("long"), 32)
        bits = F.sequence(F.lit(0), F.lit(31))
        return F.aggregate(hashes, zero, lambda acc, h: F.zip_with(acc, bits, lambda a, j: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(PAIR))))

    return F.concat(*[half(s) for s in range(SKETCH // 64)])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as an array of longs; null and blank texts have that of no paragraphs."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), lambda p: F.trim(p)), lambda p: p != "")
    # Clauses of a paragraph are what the marks part; texts of many short lines have their lines as clauses.
    clauses = F.filter(F.split(F.coalesce(text, F.lit("")), rf"(?:{SPLIT}|\s*[\r\n]+\s*)"), lambda c: F.trim(c) != "")
    return F.concat(_sum_identity(paragraphs), _sum_sketch(clauses), F.array(F.size(clauses).cast("long")))


def as_text(fp: Column) -> Column:
    """Hexadecimal form, equal for equal fingerprints."""
    return F.lower(F.array_join(F.transform(fp, lambda x, i: F.lpad(F.hex(x), F.when(i < IDENTITY, 8).otherwise(16), F.lit("0"))), ""))


def _centred(fp: Column) -> Column:
    """The sketch's lanes around 0: twice the count minus the number of clauses."""
    n = F.element_at(fp, -1)
    packed = F.slice(fp, IDENTITY + 1, SKETCH // 2)
    low = F.transform(packed, lambda x: (x.bitwiseAND(F.lit(LANE)) * 2 - n).cast("double"))
    high = F.transform(packed, lambda x: (F.shiftrightunsigned(x, 32) * 2 - n).cast("double"))
    return F.concat(low, high)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated cosine of the multisets of clauses; 1 for equal fingerprints."""
    x, y = _centred(a), _centred(b)
    norm = F.sqrt(_dot(x, x) * _dot(y, y))
    cosine = F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(x, y) / norm))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(cosine)


def _block(k: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below k: first among every width-th cut, then among those between."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda ends: F.size(F.filter(ends, lambda e: e < k))
    lasts = F.array(*[F.lit(g[-1]) for g in groups]).cast("array<long>")
    inner = F.array(*[F.array(*[F.lit(x) for x in g]).cast("array<long>") for g in groups])
    group = below(lasts)
    return F.when(group >= len(groups), F.lit(len(cuts))).otherwise(group * width + below(F.get(inner, group)))


def with_next(docs: DataFrame, *, key: str = "doc_id", columns: list[str], rows_per_block: int = 4000, most_blocks: int = 20_000) -> DataFrame:
    """docs and, as next_<column>, these columns of the next row in descending (integer) key; after the last, the first's.

    The keys are cut into blocks at keys that rows have. A row with such a key goes to its own block and
    to the one before, so each block has what follows it, and one exchange by block is all. The driver gets at most
    most_blocks keys. Null keys are last. Rows of one key are ordered by a hash of the row. If all keys are null, the
    last row has no next one. Columns of docs named next_<column> are replaced.
    """
    k = F.col(f"`{key}`").cast("long")
    ids = docs.select(k.alias("k"))
    total, first = ids.agg(F.count("*"), F.max("k")).first()
    blocks = max(1, min(most_blocks, total // rows_per_block))
    cuts: list[int] = []
    if blocks > 1 and first is not None:
        found = ids.agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
        cuts = sorted({*found} - {first})
    own = F.struct(F.coalesce(_block(k, cuts), F.lit(0)).cast("int").alias("block"), F.lit(True).alias("own"), F.lit(0).alias("wrap"))
    # The first key of block b follows the rows of block b + 1; the first key of all follows the last rows.
    before = F.when(k.isin(cuts), F.struct((own["block"] + 1).alias("block"), F.lit(False).alias("own"), F.lit(0).alias("wrap"))) if cuts else None
    wrap = F.when(k == first, F.struct(F.lit(0).alias("block"), F.lit(False).alias("own"), F.lit(1).alias("wrap"))) if first is not None else None
    places = F.array_compact(F.array(*[p for p in (own, before, wrap) if p is not None]))
    order, place, block, mine, last = fresh(docs.columns, "order", "place", "block", "own", "wrap")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {f"next_{x}" for x in columns}]
    sent = docs.withColumn(order, row_hash(docs, 11)).withColumn(place, F.explode(places))
    sent = sent.select(*kept, order, F.col(place)["block"].alias(block), F.col(place)["own"].alias(mine), F.col(place)["wrap"].alias(last))
    w = Window.partitionBy(block).orderBy(last, k.desc_nulls_last(), order)
    follows = sent.select("*", *[F.lead(f"`{c}`").over(w).alias(f"next_{c}") for c in columns])
    return follows.filter(F.col(mine)).drop(block, mine, last, order)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: fingerprints of each text, of its edited text, and likenesses; a null text is empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("fp", fingerprint(F.col("text")))
    pairs = with_next(docs, columns=["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    pairs = pairs.withColumn("efp", fingerprint(F.col("edited")))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("next_fp")), F.lit(0.0)).alias("near_next"),
    )
