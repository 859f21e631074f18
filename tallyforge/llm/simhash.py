"""SimHash near-duplicates through pivot distance tables.

1. A text's fingerprint has a bit where more than half of the hashes of its word shingles have it. Texts of one fingerprint
   are one class, however many they are.
2. Distances to 24 fixed reference fingerprints make a class's row of the pivot table. They are kept apart for the four
   blocks of bits (of `most` + 1): the coordinates of a block, and their sums over the blocks, the distances themselves.
   Two fingerprints that differ in `most` bits at most agree in some block, so all coordinates of that block are equal.
   Classes with equal coordinates in a block are a group; all links are within groups. (Distances to references over
   all 64 bits at once leave about half of random pairs each, so a grid of them replicates without bound.)
3. A group of more than GROUP classes is dealt anew by blocks of those bits in which its members may still differ, until
   it is small. Each step settles a quarter of the bits, so at most 2**9 fingerprints are left after eight.
4. In a small group the classes stand in order of the first distance; pairs whose distances to any reference differ by more
   than `most` are discarded, the rest verified. What links within a group is passed on as a tree, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, join_skewed, materialize, table
from tallyforge.llm.components import components, least_linked

SEED = 42
RUN = 255  # hashes whose bits are counted in bytes
GROUP = 512  # classes that are compared at once
REFERENCES = 24
CARRIED = "key long, fp long, open long"


def _spread(z: np.ndarray) -> np.ndarray:
    """64 bits of which each hangs on all bits of z."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: The reference fingerprints, and odd numbers by which coordinates are summed to a key.
PIVOTS = _spread(np.arange(1, REFERENCES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
WEIGHTS = _spread(np.arange(101, REFERENCES + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of the words of text, repeats included; of all words if they are fewer; none without words."""
    w = text.lower().split()  # bytes: A-Z, and the blanks \x20 and \x09-\x0D
    if not w:
        return np.zeros(0, dtype=np.uint64)
    shingles = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), RUN * 256):
        part = hashes[at : at + RUN * 256]
        part = np.concatenate([part, np.zeros(-len(part) % RUN, dtype=np.uint64)])
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.reshape(-1, RUN, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def fingerprint(text: Column, words: int = 3) -> Column:
    """The 64-bit fingerprint of a text, as a long; 0 for null and for a text without words."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = (majority(shingle_hashes(t.as_py() or b"", words)) for t in texts.cast(pa.binary()))  # one text at a time
        return pa.array(np.fromiter(found, dtype=np.uint64, count=len(texts)).view(np.int64))

    return of(text.cast("string"))


def blocks(open_bits: int, count: int) -> list[int]:
    """The set bits of open_bits, dealt over `count` blocks in turn."""
    at = [i for i in range(64) if open_bits >> i & 1]
    return [sum(1 << i for i in at[b::count]) for b in range(count)]


def coordinates(prints: np.ndarray, block: int) -> np.ndarray:
    """Distances to the references within the bits of a block: a row a fingerprint."""
    return np.bitwise_count((prints[:, None] ^ PIVOTS) & np.uint64(block))


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """key, fp and open (bits in which members of a group may differ) for each block of each of rows (key, fp, open)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp, bits = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
            for mask in np.unique(bits):
                k, f = key[bits == mask], fp[bits == mask]
                for nr, block in enumerate(blocks(int(mask), most + 1)):
                    equal = (coordinates(f, block).astype(np.uint64) * WEIGHTS).sum(axis=1, dtype=np.uint64)
                    made = _spread(_spread(k + np.uint64(nr + 1)) + equal)
                    yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(f.view(np.int64)), pa.array(np.full(len(f), mask & ~np.uint64(block)).view(np.int64))], ["key", "fp", "open"])

    return rows.mapInArrow(deal, CARRIED)


def close_pairs(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with equal keys whose fingerprints differ in `most` bits at most; key is sorted."""
    distance = coordinates(fp, (1 << 64) - 1).astype(np.int8)
    order = np.lexsort((distance[:, 0], key))
    key, fp, distance = key[order], fp[order], distance[order]
    found, at, step = [(np.zeros(0, np.int64),) * 2], np.arange(len(key)), 1
    while len(at := at[at + step < len(key)]):
        to = at + step
        near = (key[at] == key[to]) & (distance[to, 0] - distance[at, 0] <= most)
        at = at[near]  # what is too far in order stays too far
        to = at + step
        survive = np.abs(distance[at] - distance[to]).max(axis=1, initial=0) <= most
        i, j = at[survive], to[survive]
        true = np.bitwise_count(fp[i] ^ fp[j]) <= most
        found.append((order[i[true]], order[j[true]]))
        step += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ties(groups: DataFrame, most: int) -> DataFrame:
    """a and b: each class that links within a group, with one that it reaches there. groups holds small ones whole."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def tied(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            least = least_linked(len(k), *close_pairs(k, f, most))
            own = np.flatnonzero(least != np.arange(len(k)))
            return pa.RecordBatch.from_arrays([pa.array(f[own].view(np.int64)), pa.array(f[least[own]].view(np.int64))], ["a", "b"])

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            if whole:
                yield tied(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield tied(key, fp)

    return groups.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Ties a and b between distinct fingerprints (fp) that make the same components as all pairs of `most` bits or fewer."""
    held = materialize(_dealt(prints.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(-1).cast("long").alias("open")), most), "dealt")
    ties, small = None, max(GROUP, 1 << most)  # with `most` open bits or fewer there is nothing to deal by
    while total := held.count():
        counted = materialize(held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
        sized = materialize(join_skewed(held, counted, "key", "n", total), "sized")
        found = materialize(_ties(sized.filter(F.col("n") <= small), most), "ties")
        ties = found if ties is None else ties.unionByName(found)
        again = materialize(_dealt(sized.filter(F.col("n") > small).select("key", "fp", "open"), most), "dealt")
        discard(prints.sparkSession, held, counted, sized)
        held = again
    return prints.sparkSession.createDataFrame([], "a long, b long") if ties is None else ties


def link(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """id, fp and component (the least id that is reachable over links, its own included) of each row of docs.

    Rows link when their fingerprints differ in `most` bits at most. Null and empty texts and texts without words have the
    fingerprint 0 and link like any other. Repeated rows give a row each. A null id is never the least; a component
    without any id has none. No rows give none. Other columns of docs, whatever their names, are neither read nor returned.
    """
    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint(F.col(f"`{text}`"), words).alias("fp")), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), most))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    named = materialize(join_skewed(rooted, materialize(first, "first"), "root", "members", rooted.count()), "named")
    return join_skewed(rows, named.select("fp", "n", "component"), "fp", "n", rows.count()).select("id", "fp", "component")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: fingerprint and component of each document."""
    out = link(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
