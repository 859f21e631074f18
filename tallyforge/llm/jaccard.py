"""N-gram Jaccard join through PartEnum signatures, and the groups that its links make.

1. Each text becomes a set of word shingles; equal sets are one class (a class has one node however many copies it has).
2. A class emits its signatures (shingles.PartEnum): any two similar sets share at least one. Classes that share one are tied
   unless the parity bits of the two sets already differ in more places than linked sets may: two by two where they are few (FEW),
   by a tree of what may link, made in a task, where they are up to BUCKET. Where they are more, all are tied to the first of them, in a
   batch of which IN_BATCH share one there and then, so a signature that very many sets share doesn't pile up; those ties stay. What ties hold together, directly or not, is a candidate group: all links are within groups.
3. All sets of a group are compared with one of them, its pivot. D(X) is what X has and the pivot P hasn't or the other
   way round. Those that link with P are of one component.
4. Groups of more than one component get a second pivot: the set that is nearest to the group's majority (the elements that more than
   half of its sets have). Near copies of a text mostly link with that one.
   Groups of at most COMPARED sets that hold at most ELEMENTS in all are compared in a task before that, and are done.
5. X and Y differ in |D(X)| + |D(Y)| - 2 |D(X) & D(Y)| elements. So two that link, not both with P, share at least a
   number t >= 1 of elements of D that the sizes of their sets and of their D tell. Cut into t - 1 buckets by a hash, the elements of D
   hold a shared pair in some bucket (shingles.shared_pairs). Sets of different components that have such a pair
   in common are compared at once if few do, first by 128 bits of D; else they make the groups of the next round, in
   which D is all that is left of a set. Pivots are in none of them, so rounds end.

A set is compared with two pivots a round, never with all of its group, and no link between components is lost.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import discard, fresh, give_back, join_skewed, materialize, small_batches, table
from tallyforge.llm.components import components, least_linked
from tallyforge.llm.shingles import mix, odd_bits, odd_gap, parity, part_enum, set_digest, shared_pairs, shingle_set

SET = T.StructType([T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("bits", T.BinaryType())])
#: Classes that share a signature, at most: those tied two by two, those whose bits a task compares, those of a batch that stay apart.
FEW, BUCKET, IN_BATCH = 6, 4096, 128
#: Up to so many ids of documents that share a signature are broadcast (16 bytes each); more meet their texts by shuffle.
BROADCAST_IDS = 1_000_000
EMITTED = 50_000  # classes that a task remembers having emitted
ROWS = 1 << 16  # signatures of a batch; a worker keeps what memory a batch once took
SMALL = 1000  # sets that share a signature of a later round and are compared at once
#: Sets, and elements of their differences from the pivot, of a group that a task compares.
COMPARED, ELEMENTS = 1024, 4_000_000
SETS_A_TASK = 512  # of which a task makes the signatures of a later round
HOT_PIVOTS = 100  # groups at most of which the pivots are broadcast


def _short(cls: bytes) -> int:
    return struct.unpack("<q", cls[:8])[0]


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.binary()))


def shingle_classes(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """id, h (hash of the text), n (size of the set), cls (its digest, null if it is empty) and bits (shingles.odd_bits) for each row."""

    @F.arrow_udf(SET)
    def classes(t: pa.Array) -> pa.Array:
        sets = (shingle_set(x, words) for x in _texts(t))  # one at a time
        found = [{"n": len(s), "cls": set_digest(s), "bits": odd_bits(s)} if len(s) else {"n": 0, "cls": None, "bits": None} for s in sets]
        give_back()
        return pa.array(found, type=pa.struct([("n", pa.int64()), ("cls", pa.binary()), ("bits", pa.binary())]))

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), classes(F.col(text).cast("string")).alias("s")).select("id", "h", "s.n", "s.cls", "s.bits")


def _tied(sigs: np.ndarray, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, classes and whether a row stands for many: the same ties with fewer rows for a signature of more than IN_BATCH classes.

    Its first class stays, marked, and each other shares a made-up signature with that first, marked too.
    """
    order = np.lexsort((hs, sigs))
    sigs, hs = sigs[order], hs[order]
    first = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    at = np.flatnonzero(first)
    many = (np.diff(np.concatenate([at, [len(sigs)]])) > IN_BATCH)[np.cumsum(first) - 1]
    to = hs[np.maximum.accumulate(np.where(first, np.arange(len(sigs)), 0))]
    others = many & ~first
    ties = np.unique(np.stack([hs[others], to[others]], axis=1), axis=0)
    ties = ties[ties[:, 0] != ties[:, 1]]
    made = mix(ties[:, 0].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(ties[:, 1].view(np.uint64)))
    stay = first | ~many
    marks = np.concatenate([many[stay], np.ones(2 * len(made), dtype=bool)])
    return np.concatenate([sigs[stay], made, made]), np.concatenate([hs[stay], ties[:, 0], ties[:, 1]]), marks


def _signed(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The rows of signatures() of a task's texts, about ROWS at a time."""
    enum, emitted = part_enum(num, den), OrderedDict()
    sigs, hs, held = [], [], 0

    def batch() -> pa.RecordBatch:
        flat = _tied(np.concatenate(sigs), np.repeat(np.array(hs, dtype=np.int64), [len(s) for s in sigs]))
        return pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1]), pa.array(flat[2])], ["sig", "h", "many"])

    for b in batches:
        for x in _texts(b.column(0)):
            s = shingle_set(x, words)
            if not len(s):
                continue
            h = _short(set_digest(s))
            if h in emitted:
                emitted.move_to_end(h)
                continue
            emitted[h] = None
            if len(emitted) > EMITTED:
                emitted.popitem(last=False)
            sigs.append(enum.signatures(s))
            hs.append(h)
            held += len(sigs[-1])
            if held >= ROWS:
                yield batch()
                sigs, hs, held = [], [], 0
        del b
        give_back()
    if sigs:
        yield batch()
        give_back()


def signatures(docs: DataFrame, text: str, words: int, num: int, den: int) -> DataFrame:
    """sig, h (first half of the digest) and many of the sets of docs; null texts and those without words have none.

    Of the classes of a batch that share a signature with many others, all but one have made-up ones instead (see _tied), which
    tie the same classes together. Equal texts of a batch count once. Columns of docs other than the text aren't read.
    """

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lambda batches: _signed(batches, words, num, den), "sig long, h long, many boolean")


def may_link_tree(n: np.ndarray, bits: list[bytes | None], num: int, den: int) -> np.ndarray:
    """For each of some sets (of n elements) the place of the first that it reaches over pairs whose bits allow a link; no bits allow all."""
    rows = [np.frombuffer(b or b"", dtype=np.uint64) for b in bits]
    words, free, first = np.array([len(r) for r in rows]), np.ones(len(rows), dtype=bool), np.arange(len(rows))
    if not words.all():
        return np.zeros(len(rows), dtype=np.int64)
    fold = lambda r: r[..., : r.shape[-1] // 2] ^ r[..., r.shape[-1] // 2 :]
    at = {w: np.flatnonzero(words == w) for w in np.unique(words)}
    flat = {w: np.stack([rows[i] for i in own]) for w, own in at.items()}
    for start in range(len(rows)):
        todo = [start] if free[start] else []
        free[start] = False
        while todo:  # a set is held against those that nothing has reached yet
            i = todo.pop()
            for w, own in at.items():
                if not w // 2 <= words[i] <= 2 * w:
                    continue  # bits of sets that link have one length or the next; the longer ones are folded
                near = np.flatnonzero(free[own] & (n[own] * den >= num * n[i]) & (n[i] * den >= num * n[own]))
                if len(near):
                    theirs, mine = flat[w][near], rows[i]
                    theirs, mine = (fold(theirs), mine) if w > words[i] else (theirs, fold(mine) if w < words[i] else mine)
                    differ, both = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64), n[own[near]] + n[i]
                    met = own[near[den * (both - differ) >= num * (both + differ)]]
                    free[met], first[met] = False, start
                    todo += met.tolist()
    return first


def _bucket_trees(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a and b: a tree of what may link in each bucket of rows (sig, h, n, bits); a bucket is at most BUCKET rows."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, h, n, bits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def tree(end: int, start: int) -> tuple[np.ndarray, np.ndarray]:
            first = may_link_tree(n[start:end], bits[start:end], num, den)
            own = np.flatnonzero(first != np.arange(end - start))
            return h[start + own], h[start + first[own]]

        def made(end: int) -> pa.RecordBatch:
            edges = np.concatenate([[0], np.flatnonzero(np.diff(sig[:end])) + 1, [end]])
            ties = [tree(b, a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*ties, strict=True)], ["a", "b"])

        for b in batches:
            sig, h, n = (np.concatenate([old, b.column(c).to_numpy()]) for old, c in ((sig, "sig"), (h, "h"), (n, "n")))
            bits += b.column("bits").to_pylist()
            whole = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0  # the last bucket may go on
            if whole:
                yield made(whole)
                sig, h, n, bits = sig[whole:], h[whole:], n[whole:], bits[whole:]
        if len(sig):
            yield made(len(sig))

    dealt = rows.select("sig", "h", "n", "bits").repartition("sig").sortWithinPartitions("sig")
    return dealt.mapInArrow(trees, "a long, b long").distinct()


def _ties(shared: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """a and b: ties by signatures (sig, h, many) that may hold a link; classes has cls, n and bits."""
    w = Window.partitionBy("sig")
    # A class may stand more than once under a signature: its first row in order is the one that counts.
    new = F.coalesce(F.col("h") != F.lag("h").over(w.orderBy("h")), F.lit(True))
    marked = shared.withColumn("new", new).select("sig", "h", "new", F.min("h").over(w).alias("b"), F.count_if("new").over(w).alias("times"), F.max("many").over(w).alias("many"))
    marked = materialize(marked.filter("new and times > 1").drop("new"), "shared")
    star = (F.col("times") > BUCKET) | F.col("many")
    pairwise = (F.col("times") <= FEW) & ~star
    kept = marked.filter(star & (F.col("h") != F.col("b"))).select(F.col("h").alias("a"), "b").distinct()
    few = marked.filter(pairwise).groupBy("sig").agg(F.array_sort(F.collect_set("h")).alias("hs")).select("hs").distinct()
    pairs = F.flatten(F.transform("hs", lambda x, i: F.transform(F.slice("hs", i + 2, FEW), lambda y: F.struct(y.alias("a"), x.alias("b")))))
    pairs = materialize(few.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), "pairs")
    short = classes.select(_short_udf("cls").alias("h"), "n", "bits").groupBy("h").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), F.count("*").alias("times"))
    # Classes of one short digest can't be told apart here, so their ties stay.
    known = materialize(short.select("h", "n", F.when(F.col("times") == 1, F.col("bits")).alias("bits")), "bits")
    both = pairs.join(known.select(F.col("h").alias("a"), "n", "bits"), "a").join(known.select(F.col("h").alias("b"), F.col("n").alias("m"), F.col("bits").alias("others")), "b")

    @F.arrow_udf("boolean")
    def may_link(n: pa.Array, bits: pa.Array, m: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for a, x, b, y in zip(n, bits, m, others, strict=True):
            a, x, b, y = a.as_py(), x.as_py(), b.as_py(), y.as_py()
            differ = 0 if x is None or y is None else odd_gap(x, y)
            out.append(den * (a + b - differ) >= num * (a + b + differ))
        return pa.array(out, pa.bool_())

    # A bucket that other signatures have too is looked at once.
    mid = marked.filter(~star & ~pairwise).withColumn("which", F.sum(F.xxhash64("h").bitwiseAND(F.lit((1 << 40) - 1))).over(w))
    alone = mid.groupBy("which", "times").agg(F.min("sig").alias("sig")).select("sig")
    trees = _bucket_trees(mid.select("sig", "h").join(alone, "sig", "left_semi").join(known, "h"), num, den)
    out = materialize(kept.unionByName(both.filter(may_link("n", "bits", "m", "others")).select("a", "b")).unionByName(trees), "ties")
    discard(shared.sparkSession, marked, pairs, known)
    return out


def _node(doc: str, cls: str) -> Column:
    """A class by its least id and its digest; those without an id are ordered last, so they aren't roots of others."""
    return F.struct(F.col(doc).isNull().alias("no_id"), F.col(doc).alias("doc"), F.col(cls).alias("cls"))


def _groups(ties: DataFrame) -> DataFrame:
    """node and the root of its group, roots included, for ties (a, b)."""
    tied = materialize(components(ties), "groups")
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())


def _sets(docs: DataFrame, id_col: str, text: str, words: int, members: DataFrame) -> DataFrame:
    """members (x, id and h of one row of each, more) with s, their sorted shingle hashes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0

        def batch() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), lists], ["x", "s"])

        for b in batches:
            for x in _texts(b.column(0)):
                s = shingle_set(x, words)
                sets += [s] if len(s) else []
                held += len(s)
                if held >= ROWS:
                    yield batch()
                    sets, held = [], 0
            del b
            give_back()
        if sets:
            yield batch()
            give_back()

    keys = _small(members.select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("t"))
    rows = texts.join(keys, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
    found = rows.select("t").mapInArrow(whole, "x binary, s array<long>")
    return found.join(_small(members.drop("id", "h")), "x").dropDuplicates(["x"])


def _differences(items: DataFrame, num: int, den: int) -> DataFrame:
    """items (g, x, n, s, rank) compared with the pivot p of their g, that of the least rank.

    What two items of a g differ in are the elements that only one of their s has. n is the size of the whole set. Gives g, x,
    n, p, linked and s (the difference from p); p itself is left out.
    """
    pivots = items.groupBy("g").agg(F.min(F.struct("rank", "x")).alias("least"), F.count("*").alias("members"))
    pivots = pivots.select("g", F.col("least.x").alias("p"), "members")
    own = pivots.join(items.select(F.col("x").alias("p"), F.col("n").alias("pn"), F.col("s").alias("ps")), "p").select("g", "members", "p", "pn", "ps")
    both = join_skewed(items.drop("rank"), materialize(own, "pivots"), "g", "members", items.count(), HOT_PIVOTS).filter("x <> p")
    d = F.concat(F.array_except("s", "ps"), F.array_except("ps", "s"))
    both = both.select("g", "x", "n", "p", "pn", d.alias("s"))
    return both.select("g", "x", "n", "p", _links(F.col("n"), F.col("pn"), F.size("s").cast("long"), num, den).alias("linked"), "s")


def _links(n: Column, pn: Column, differ: Column, num: int, den: int) -> Column:
    """Whether sets of n and pn elements that differ in so many link."""
    return F.lit(den) * (n + pn - differ) >= F.lit(num) * (n + pn + differ)


def _open(judged: DataFrame) -> DataFrame:
    """The rows of judged (with roots) of which the g holds more than one root; adds members, how many g has, and their elements."""
    roots = judged.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"), F.sum(F.size("s")).alias("elements")).filter("lo <> hi")
    return join_skewed(judged, materialize(roots.select("g", "members", "elements"), "open-groups"), "g", "members", judged.count())


def linked_in_group(n: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set (of n elements, given by its differences from one pivot) the place of the first that it reaches over links.

    Elements that a single set has are left out of the products that count what two sets share.
    """
    size = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], column[several]
    shared, width = np.zeros((len(sets), len(sets))), 4096
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        shared += has @ has.T
    both, differ = n[:, None] + n[None, :], size[:, None] + size[None, :] - 2 * shared
    i, j = np.nonzero(np.triu(den * (both - differ) >= num * (both + differ), 1))
    return least_linked(len(sets), i, j)


def _in_groups(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that hold together what links within each g of rows (g, x, n, s): a tree, not all pairs."""

    def tree(t: pa.Table) -> pa.Table:
        t = t.sort_by("x")
        sets = [s.values.to_numpy(zero_copy_only=False) for s in t.column("s")]
        first = linked_in_group(t.column("n").to_numpy(), sets, num, den)
        own = np.flatnonzero(first != np.arange(len(sets)))
        x = t.column("x")
        return pa.table({"a": x.take(pa.array(own)), "b": x.take(pa.array(first[own]))})

    return rows.select("g", "x", "n", "s").groupBy("g").applyInArrow(lambda t: tree(t), "a binary, b binary")


def _around_majority(rows: DataFrame) -> DataFrame:
    """Items with the distance from their group's majority as rank, for rows (g, x, n, s, members)."""
    counted = rows.select("g", "members", F.explode("s").alias("e")).groupBy("g", "members", "e").agg(F.count("*").alias("have"))
    major = counted.filter("2 * have > members").groupBy("g", "members").agg(F.collect_list("e").alias("major"))  # at most twice a mean s
    found = join_skewed(rows.drop("members"), materialize(major, "majorities"), "g", "members", rows.count(), HOT_PIVOTS, how="left")
    major = F.coalesce("major", F.array().cast("array<bigint>"))
    return found.select("g", "x", "n", "s", (F.size(F.array_except("s", major)) + F.size(F.array_except(major, F.col("s")))).alias("rank"))


def _later_signatures(rows: DataFrame, num: int, den: int) -> DataFrame:
    """sig, x, r (hash of its root), n, its parity bits, and members, for the sets of rows that may link with one of another root."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row as often as it has shared pairs (t), with the bits of its s instead of s."""
        enum = part_enum(num, den)
        for b in batches:
            n, s = b.column("n").to_pylist(), b.column("s")
            at, bits, found, held = [], [], [], 0

            def batch(b=b) -> pa.RecordBatch:
                times = pa.array(np.repeat(np.array(at), [len(f) for f in found]))
                each = np.repeat(np.array(bits, dtype=np.uint64).view(np.int64), [len(f) for f in found], axis=0)
                cols = [b.column(c).take(times) for c in ("x", "r", "n", "linked", "g")]
                return pa.RecordBatch.from_arrays([*cols, pa.array(each[:, 0]), pa.array(each[:, 1]), pa.array(np.concatenate(found).view(np.int64))], ["x", "r", "n", "linked", "g", "b0", "b1", "t"])

            for i in range(len(n)):
                d = np.sort(s[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                found.append(shared_pairs(d, n[i], enum))
                bits.append(parity(d))
                at.append(i)
                held += len(found[-1])
                if held >= ROWS:
                    yield batch()
                    at, bits, found, held = [], [], [], 0
            if held:
                yield batch()

    marked = rows.select("x", F.xxhash64("root").alias("r"), "n", "linked", F.xxhash64("g").alias("g"), "s")
    marked = marked.repartition(max(1, -(-rows.count() // SETS_A_TASK)), "x")  # few sets make many rows
    kept = marked.mapInArrow(emit, "x binary, r long, n long, linked boolean, g long, b0 long, b1 long, t long")
    kept = materialize(kept.select(F.xxhash64("g", "t").alias("sig"), "x", "r", "n", "linked", "b0", "b1"), "shared-pairs")
    useful = kept.groupBy("sig").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.bool_or(~F.col("linked")).alias("apart"), F.count("*").alias("members"))
    useful = materialize(useful.filter("lo <> hi and apart").select("sig", "members"), "useful")
    out = materialize(join_skewed(kept.drop("linked"), useful, "sig", "members", kept.count()), "later-signatures")
    discard(rows.sparkSession, kept, useful)
    return out


def _few(found: DataFrame, judged: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of sets of different roots, of which few share a signature.

    The parity bits of two sets differ in no more places than the sets do, so the join leaves out most pairs
    that don't link; the others are compared by their elements.
    """
    few = found.filter(F.col("members") <= SMALL).drop("members")
    other = few.select("sig", *[F.col(c).alias(f"y_{c}") for c in ("x", "r", "n", "b0", "b1")])
    bits = F.bit_count(F.col("b0").bitwiseXOR(F.col("y_b0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("y_b1")))
    near = (few["sig"] == other["sig"]) & (F.col("x") < F.col("y_x")) & (F.col("r") != F.col("y_r")) & _links(F.col("n"), F.col("y_n"), bits.cast("long"), num, den)
    pairs = few.join(other, near).select("x", F.col("y_x").alias("y")).distinct()
    s = judged.select("x", "n", "s")
    both = pairs.join(s, "x").join(s.select(F.col("x").alias("y"), F.col("n").alias("yn"), F.col("s").alias("ys")), "y")
    differ = F.size("s") + F.size("ys") - 2 * F.size(F.array_intersect("s", "ys"))
    return both.filter(_links(F.col("n"), F.col("yn"), differ.cast("long"), num, den)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _components(items: DataFrame, num: int, den: int) -> DataFrame | None:
    """x and root of the classes that links join to others; items are the sets of candidate groups (see _differences)."""
    spark, labels = items.sparkSession, None

    def label(links: DataFrame) -> DataFrame | None:
        links = materialize(links, "links")
        if links.isEmpty():
            return labels
        known = links if labels is None else links.unionByName(labels.select(F.col("x").alias("a"), F.col("root").alias("b")))
        return components(known).select(F.col("node").alias("x"), "root")

    def rooted(df: DataFrame) -> DataFrame:
        if labels is None:
            return df.withColumn("root", F.col("x"))
        return df.join(labels, "x", "left").withColumn("root", F.coalesce("root", "x"))

    def compared(items: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
        judged = materialize(_differences(items, num, den), name)
        return judged, label(judged.filter("linked").select(F.col("p").alias("a"), F.col("x").alias("b")))

    def opened(judged: DataFrame) -> DataFrame:
        both = materialize(rooted(judged), "rooted")
        out = materialize(_open(both), "open")
        discard(spark, both)
        return out

    while True:
        first, labels = compared(items, "judged")
        open_ = opened(first)
        small = (F.col("members") <= COMPARED) & (F.col("elements") <= ELEMENTS)
        labels = label(_in_groups(open_.filter(small), num, den))
        open_ = materialize(open_.filter(~small).drop("elements"), "open")
        if open_.isEmpty():
            return labels
        central = materialize(_around_majority(open_), "central")
        judged, labels = compared(central, "judged-centrally")
        discard(spark, first, open_, central)
        open_ = opened(judged).drop("elements")
        found = _later_signatures(open_, num, den)
        labels = label(_few(found, judged, num, den))
        discard(spark, items, open_)
        # Of those that share a signature with many, the groups that still hold more than one component.
        many = found.filter(F.col("members") > SMALL)
        if many.isEmpty():
            return labels
        least = many.groupBy("sig").agg(F.min("x").alias("b"), F.max("members").alias("times"))
        ties = join_skewed(many.select("sig", "x"), least, "sig", "times", many.count()).filter("x <> b").select(F.col("x").alias("a"), "b")
        group = _groups(ties).withColumnsRenamed({"node": "x", "root": "g"})
        items = materialize(judged.select("x", "n", "s").join(group, "x").select("g", "x", "n", "s", F.size("s").alias("rank")), "items")


def link(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """id, h (hash of the text), n (size of the shingle set), component and root for each row of docs.

    Two rows link when the Jaccard similarity of their sets is num / den or more; component is the smallest id that is
    reachable by links, the row's own included. A text of fewer words is one shingle; a text without words, or
    null, has an empty set, links with nothing, and is a component of its own. Rows that repeat each other
    are one class. Rows with one id but other texts are judged by their own texts. A null id is larger than no other: it is
    a component's id only if all its ids are null. root is the digest of the component's set of least id, null for an
    empty set. Other columns of docs are ignored. An empty docs gives an empty result.
    """
    with small_batches(docs.sparkSession):  # the jobs of a result that is read later have no Python
        return _linked(docs, id_col, text, words, num, den)


def _linked(docs: DataFrame, id_col: str, text: str, words: int, num: int, den: int) -> DataFrame:
    rows = materialize(shingle_classes(docs, id_col, text, words), "classes")
    filled = rows.filter(F.col("cls").isNotNull())
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    classes = filled.groupBy("cls").agg(F.min(row).alias("row"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.count("*").alias("copies"))
    # short is written: a join by a Python column makes it twice, for the join drops nulls first, with two workers a task.
    classes = materialize(classes.select("cls", "row.id", "row.h", "n", "copies", "bits", _short_udf("cls").alias("short")), "class-nodes")
    ties = _ties(signatures(docs, text, words, num, den), classes, num, den)
    group = _groups(ties).withColumnsRenamed({"node": "short", "root": "g"})
    # Classes of one short digest are in one group, which is as good as any that holds both.
    members = classes.join(group, "short")
    members = members.select(F.col("cls").alias("x"), "id", "h", "g", "n", (-F.col("copies")).alias("rank"))
    members = materialize(members, "members")
    items = materialize(_sets(docs, id_col, text, words, members).select("g", "x", "n", "s", "rank"), "sets")
    discard(docs.sparkSession, ties, members)
    labels = _components(items, num, den)

    nodes = classes.select(F.col("cls").alias("x"), "id", "copies")
    nodes = nodes.withColumn("root", F.col("x")) if labels is None else nodes.join(labels, "x", "left").withColumn("root", F.coalesce("root", "x"))
    nodes = materialize(nodes, "rooted-classes")
    least = nodes.groupBy("root").agg(F.min(_node("id", "x")).alias("least"), F.count("*").alias("members"))
    by_class = join_skewed(nodes, least, "root", "members", nodes.count()).select(F.col("x").alias("cls"), "least", "copies")
    linked = join_skewed(filled, materialize(by_class, "labelled-classes"), "cls", "copies", filled.count())
    linked = linked.select("id", "h", "n", F.col("least.doc").alias("component"), F.col("least.cls").alias("root"))
    alone = rows.filter(F.col("cls").isNull())
    return linked.unionByName(alone.select("id", "h", "n", F.col("id").alias("component"), F.col("cls").alias("root")))


def _small(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of docs for each component of link(): that of the least id, all columns as they were.

    Ties go to the least hash of the text; of rows that repeat both, one stays, whichever it is. A row without words
    links with nothing and stays. A null id counts as larger than any other.
    """
    found = materialize(link(docs, id_col=id_col, text=text, words=words, num=num, den=den).select("id", "h", "root"), "links")
    groups = found.filter(F.col("root").isNotNull())
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("h"))
    least = groups.groupBy("root").agg(F.min(rank).alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    marked = join_skewed(groups, least, "root", "rows", max(1, groups.count()))
    own = rank == F.col("least")
    keys = marked.groupBy("id", "h").agg(F.bool_or(own).alias("stays"), F.count("*").alias("times"))
    keys = materialize(keys.filter("not stays or times > 1"), "dropped")

    (h,) = fresh(docs.columns, "h")
    keyed = docs.withColumn(h, F.xxhash64(text))
    same = lambda k: F.col(f"`{id_col}`").eqNullSafe(k["id"]) & (F.col(h) == k["h"])
    gone = keys.filter("not stays").select("id", "h")
    rest = keyed.join(_small(gone), same(gone), "left_anti")
    again = keys.filter("stays and times > 1").select("id", "h")
    if again.isEmpty():
        return rest.drop(h)
    once = rest.join(_small(again), same(again), "left_semi").dropDuplicates([id_col, h])
    return rest.join(_small(again), same(again), "left_anti").unionByName(once).drop(h)


@F.arrow_udf(T.LongType())
def _short_udf(cls: pa.Array) -> pa.Array:
    return pa.array([_short(c) for c in cls.to_pylist()], pa.int64())


def query(spark, sf_dir: str) -> DataFrame:
    """op8: three-word shingles, 90 % similarity."""
    found = link(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(src, dst) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT r.src, CASE WHEN e.a = r.dst THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.dst OR e.b = r.dst
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT src AS doc_id, min(dst) AS component_id FROM r GROUP BY src) m USING (doc_id)
"""
