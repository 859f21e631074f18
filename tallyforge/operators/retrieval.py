"""Nearest rows by vector, with filters and blends, for many queries in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.windows import exact_quantiles

#: Rows of vectors in a block, about; each pair of blocks is one task's matrix product.
BLOCK_ROWS = 2048
#: Rows of a block, at most, and how many blocks there are before they grow to that, where scores are estimated tile by tile.
WIDE_ROWS, WIDE_BLOCKS = 16384, 32
#: Queries and rows of a tile.
TILE_QUERIES, TILE_ROWS = 256, 4096


def block_pairs(queries: DataFrame, rows: DataFrame, key: str, upper: bool = False, by: Sequence[str] = (), wide: bool = False):
    """Rows of each pair of a block of queries and a block of rows, grouped; _side is 0 for queries.

    Both frames have the same columns. A block is a hash of the key, so the plan has one join of any size and neither the driver nor a
    broadcast holds vectors. upper leaves out pairs below the diagonal, for frames that are the same. by names columns that
    a pair has in common, such as a variant; blocks are as many as the largest of its values needs. wide is for tasks that take
    a pair in tiles: its blocks grow to WIDE_ROWS, so that rows are copied less often.
    """
    largest = lambda df: df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    block = lambda n: min(WIDE_ROWS, max(BLOCK_ROWS, -(-n // WIDE_BLOCKS))) if wide else BLOCK_ROWS
    per = [max(1, -(-n // block(n))) for n in map(largest, (queries, rows))]
    own = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_side", F.lit(0)).withColumn("_q", own(per[0])).withColumn("_r", every(per[1]))
    r = rows.withColumn("_side", F.lit(1)).withColumn("_r", own(per[1])).withColumn("_q", every(per[0]))
    both = q.unionByName(r)
    return (both.filter("_q <= _r") if upper else both).groupBy(*by, "_q", "_r")


def side(pair: pa.Table, n: int, key: str) -> pa.Table:
    """The queries (0) or rows (1) of a pair of blocks, by key."""
    return pair.filter(pc.equal(pair.column("_side"), n)).sort_by(key)


def matrix(part: pa.Table, vector: str) -> np.ndarray:
    if not part.num_rows:
        return np.zeros((0, 0))
    flat = part.column(vector).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)


def units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Dot products summed in one order, so a pair has the same score in whatever block, and equal vectors tie."""
    out = np.zeros((len(q), len(v)))
    for i in range(q.shape[1] if len(q) and len(v) else 0):
        out += q[:, i, None] * v[None, :, i]
    return out


class Cosines:
    """Cosines of the rows of two matrices: exact ones of given places, in the order of scores(), and estimates of a tile by a product.

    An estimate is less than slack from the exact value; in single precision that is some 1e-5.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, single: bool = True, plain: bool = False):
        a, b = (a, b) if plain else (units(a), units(b))  # plain: they are of length 1
        self.a, self.b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        kind = np.float32 if single else np.float64
        self.left, self.right = a.astype(kind), np.ascontiguousarray(b.T.astype(kind))
        self.slack = 4 * (a.shape[1] + 8) * float(np.finfo(kind).eps)
        self.size = (len(a), len(b)) if a.shape[1] == b.shape[1] else (0, 0)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast(i, j).shape)
        for x, y in zip(self.a, self.b, strict=True):
            out += x[i] * y[j]
        return out

    def rough(self, i: slice, j: slice) -> np.ndarray:
        return self.left[i] @ self.right[:, j]


class Closeness:
    """The same for weighted_closeness(), rounded."""

    slack = 1e-6  # roots of sums that cancel to about 1e-14

    def __init__(self, a: np.ndarray, b: np.ndarray, weights: Sequence[float], digits: int):
        self.weights, self.digits, self.total = [float(w) for w in weights], digits, sum(weights)
        self.a, self.b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        root = np.sqrt(np.array(self.weights) / self.total)
        self.left, right = (a * root, b * root) if a.size and b.size else (a, b)
        self.right = np.ascontiguousarray(right.T)
        self.far, self.near = (self.left**2).sum(axis=1), (right**2).sum(axis=1)
        self.size = (len(a), len(b)) if a.shape[1] == b.shape[1] else (0, 0)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        gaps = np.zeros(np.broadcast(i, j).shape)
        for x, y, w in zip(self.a, self.b, self.weights, strict=True):
            gaps += w * (x[i] - y[j]) ** 2
        return np.clip(1 - np.sqrt(gaps / self.total), 0, 1).round(self.digits)

    def rough(self, i: slice, j: slice) -> np.ndarray:
        d = self.left[i] @ self.right[:, j]
        d *= -2
        d += self.far[i, None]
        d += self.near[None, j]
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
        np.subtract(1, d, out=d)
        return np.maximum(d, 0, out=d)


def tiles(size: tuple[int, int]):
    """Slices of queries, each with those of rows in order."""
    for i in range(0, size[0], TILE_QUERIES):
        yield slice(i, min(i + TILE_QUERIES, size[0])), [slice(j, min(j + TILE_ROWS, size[1])) for j in range(0, size[1], TILE_ROWS)]


def exact_at(measure, i: slice, j: slice, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Exact scores of some places of a tile; where they are many, of all of it."""
    if len(qi) * 16 < (i.stop - i.start) * (j.stop - j.start):
        return measure.exact(qi, ri)
    whole = measure.exact(np.arange(i.start, i.stop)[:, None], np.arange(j.start, j.stop)[None, :])
    return whole[qi - i.start, ri - j.start]


def leaders(measure, n: int, drop: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and exact scores, of the n best rows of each query; ties by place of the row.

    Only rows of which the estimate is not below what n others have are scored exactly, so a pair costs little more than its share of a matrix
    product. drop tells for places of queries and rows which pairs do not count.
    """
    out = []
    for i, parts in tiles(measure.size):
        own, full = np.arange(i.start, i.stop), i.stop - i.start
        q, r, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(full, -np.inf)  # the n-th best exact score so far
        for j in parts:
            sims, edge = measure.rough(i, j), least - measure.slack
            if np.isinf(least).any():
                sims = np.where(drop(own[:, None], np.arange(j.start, j.stop)[None, :]), -np.inf, sims)
                groups = max(n, 128)
                width = (j.stop - j.start) // groups
                if width > 1:  # n groups have a row each that is as good as the n-th best of their largest
                    most = sims[:, : width * groups].reshape(full, width, groups).max(axis=1)
                    edge = np.maximum(edge, np.partition(most, groups - n, axis=1)[:, groups - n] - 2 * measure.slack)
            near = np.flatnonzero((sims >= edge[:, None].astype(sims.dtype) - np.finfo(sims.dtype).eps) & (sims > -np.inf))
            qi, ri = np.divmod(near, j.stop - j.start)
            qi, ri = qi + i.start, ri + j.start
            score = exact_at(measure, i, j, qi, ri)
            ok = (score > least[qi - i.start]) & ~drop(qi, ri)  # rows come in order, so a later one loses a tie
            if not ok.any():
                continue
            q, r, s = np.concatenate([q, qi[ok]]), np.concatenate([r, ri[ok]]), np.concatenate([s, score[ok]])
            order = np.lexsort((r, -s, q))
            q, r, s = q[order], r[order], s[order]
            first = np.searchsorted(q, own)
            stay = np.arange(len(q)) - first[q - i.start] < n
            q, r, s = q[stay], r[stay], s[stay]
            ends = np.searchsorted(q, own, side="right") - 1
            has = np.bincount(q - i.start, minlength=full) == n
            least[has] = s[ends[has]]
        out.append((q, r, s))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def counted_before(measure, score: np.ndarray, ahead: Callable, same: Callable, digits: int | None = None) -> np.ndarray:
    """For each query how many rows come before a score: those above it, and those equal to it of which ahead(query, row) is true.

    Estimates settle all but what is within slack of the score, which is worked out exactly (rounded to digits, if given). same tells which
    pairs do not count.
    """
    n = np.zeros(measure.size[0], np.int64)
    slack = measure.slack + (10.0**-digits if digits else 0)
    for i, parts in tiles(measure.size):
        own = score[i]
        for j in parts:
            sims = measure.rough(i, j).astype(np.float64, copy=False)
            if same(i, j):
                sims[same(i, j, True)] = -np.inf
            above = sims > (own + slack)[:, None]
            n[i] += np.count_nonzero(above, axis=1)
            qi, ri = np.divmod(np.flatnonzero((sims >= (own - slack)[:, None]) & ~above), j.stop - j.start)
            qi, ri = qi + i.start, ri + j.start
            found = exact_at(measure, i, j, qi, ri)
            found = found if digits is None else np.round(found, digits)
            n += np.bincount(qi[(found > score[qi]) | ((found == score[qi]) & ahead(qi, ri))], minlength=len(n))
    return n


def same_keys(ks: np.ndarray, ids: np.ndarray) -> Callable:
    """Whether a tile has pairs of one key, and, if asked for, which."""

    def same(i: slice, j: slice, which: bool = False):
        return ks[i, None] == ids[None, j] if which else bool(np.isin(ks[i], ids[j]).any())

    return same


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def top_matches(queries: DataFrame, rows: DataFrame, key: str, vector: str, n: int, *, carry: Sequence[str] = (), apart: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """For each query the n rows with the largest cosine (not the query itself), exactly, with rank; ties by key.

    apart names a column of which a match has another value than the query, by columns of which it has the same. Each pair of blocks keeps n rows a
    query, and a window limit joins what they found.
    """
    cols = list(dict.fromkeys([*by, key, vector, *carry, *([apart] if apart else [])]))
    schema = f"query {_kind(rows, key)}, {key} {_kind(rows, key)}, cosine double" + "".join(f", {c} {_kind(rows, c)}" for c in [*by, *carry])

    def best(pair: pa.Table) -> pa.Table:
        q, r = side(pair, 0, key), side(pair, 1, key)
        ks, ids = q.column(key).to_numpy(), r.column(key).to_numpy()
        here, there = (q.column(apart).to_numpy(), r.column(apart).to_numpy()) if apart else (None, None)
        drop = lambda i, j: (ks[i] == ids[j]) | (here[i] == there[j]) if apart else ks[i] == ids[j]
        qi, ri, cosine = leaders(Cosines(matrix(q, vector), matrix(r, vector)), n, drop)
        return pa.table({"query": q.column(key).take(pa.array(qi)), key: r.column(key).take(pa.array(ri)), "cosine": cosine, **{c: r.column(c).take(pa.array(ri)) for c in [*by, *carry]}})

    has = lambda df: df.filter(F.col(vector).isNotNull()).select(*cols)  # noqa: E731  a null vector matches nothing
    found = block_pairs(has(queries), has(rows), key, by=by, wide=True).applyInArrow(best, schema)
    places = Window.partitionBy(*by, "query").orderBy(F.desc("cosine"), key)
    return found.withColumn("rank", F.row_number().over(places)).filter(F.col("rank") <= n)


def closest(queries: DataFrame, rows: DataFrame, key: str, vector: str, weights: Sequence[float], n: int, *, digits: int = 9) -> DataFrame:
    """best_matches() by weighted_closeness() of one vector, rounded to so many digits: query, key, score and rank, exactly."""
    kind = _kind(rows, key)

    def best(pair: pa.Table) -> pa.Table:
        q, r = side(pair, 0, key), side(pair, 1, key)
        ks, ids = q.column(key).to_numpy(), r.column(key).to_numpy()
        qi, ri, score = leaders(Closeness(matrix(q, vector), matrix(r, vector), weights, digits), n, lambda i, j: ks[i] == ids[j])
        return pa.table({"query": q.column(key).take(pa.array(qi)), key: r.column(key).take(pa.array(ri)), "score": score})

    has = lambda df: df.select(key, vector).dropna()
    found = block_pairs(has(queries), has(rows), key, wide=True).applyInArrow(best, f"query {kind}, {key} {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", place).filter(F.col("rank") <= n).select("query", key, "score", "rank")


def angular_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for the same direction, 0 for the opposite one; of each row of a with each of b."""
    return 1 - np.arccos(np.clip(scores(units(a), units(b)), -1, 1)) / math.pi


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of minima over sum of maxima of non-negative vectors; NaN where both are zero."""
    least, most = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for i in range(a.shape[1] if len(a) and len(b) else 0):
        least += np.minimum(a[:, i, None], b[None, :, i])
        most += np.maximum(a[:, i, None], b[None, :, i])
    return np.divide(least, most, out=np.full(least.shape, np.nan), where=most > 0)


def weighted_closeness(a: np.ndarray, b: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """1 less the root of the weighted mean of squared gaps, within 0 and 1."""
    gaps = np.zeros((len(a), len(b)))
    for i, w in enumerate(weights if len(a) and len(b) else ()):
        gaps += w * (a[:, i, None] - b[None, :, i]) ** 2
    return np.clip(1 - np.sqrt(gaps / sum(weights)), 0, 1)


def preset_weights(presets: dict[str, dict[str, float]], name: str, features: Sequence[str]) -> list[float]:
    """The weight of each feature in a named preset, 1 where it names none; an unknown preset is an error."""
    if name not in presets:
        raise ValueError(f"there is no preset {name!r}")
    return [float(presets[name].get(f, 1.0)) for f in features]


def covered_blend(stable: np.ndarray, detailed: np.ndarray, covered: np.ndarray, share: float = 0.5) -> np.ndarray:
    """The stable score, mixed with the detailed one where both rows have detail."""
    return np.where(covered, stable * (1 - share) + detailed * share, stable)


def _arrays(part: pa.Table, columns: Sequence[str]) -> dict[str, np.ndarray]:
    return {c: matrix(part, c) if pa.types.is_list(part.schema.field(c).type) else part.column(c).to_numpy() for c in columns}


def _scored(pair: pa.Table, key: str, columns: Sequence[str], score: Callable, keep: Callable | None) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Both sides of a pair of blocks and the scores of their rows; -inf for a row with itself, where keep is false, and for no score."""
    q, r = side(pair, 0, key), side(pair, 1, key)
    a, b = _arrays(q, columns), _arrays(r, columns)
    if not q.num_rows or not r.num_rows:
        return q, r, np.zeros((q.num_rows, r.num_rows))
    sims = np.where(q.column(key).to_numpy()[:, None] == r.column(key).to_numpy()[None, :], -np.inf, score(a, b))
    if keep is not None:
        sims = np.where(keep(a, b), sims, -np.inf)
    return q, r, np.where(np.isnan(sims), -np.inf, sims)


def best_matches(queries: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], score: Callable, n: int, *, keep: Callable | None = None, unique: str | None = None) -> DataFrame:
    """query, key, score and rank of the n rows with the largest score for each query, exactly; not itself; ties by key.

    score and keep get the columns of a block of queries and of one of rows (name to array, vectors as matrices) and give a matrix. unique
    takes the best row of each of its values only. Rows without one of the columns match nothing. Each pair of blocks keeps n rows a query.
    """
    kind = dict(rows.dtypes)
    cols = list(dict.fromkeys([key, *columns, *([unique] if unique else [])]))
    schema = f"query {kind[key]}, {key} {kind[key]}, score double" + (f", {unique} {kind[unique]}" if unique else "")

    def best(pair: pa.Table) -> pa.Table:
        q, r, sims = _scored(pair, key, columns, score, keep)
        order = np.argsort(-sims, axis=1, kind="stable")  # rows are by key, so ties are too
        if unique and sims.size:
            of = np.unique(np.array(r.column(unique).to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
            chosen = []
            for line in order:
                first = np.sort(np.unique(of[line], return_index=True)[1])
                chosen.append(np.pad(line[first], (0, len(line) - len(first)), constant_values=-1)[: max(n, 1)])
            order = np.array(chosen)
        at = order[:, :n]
        qi, ri = np.repeat(np.arange(len(at)), at.shape[1]), at.ravel()
        ok = (ri >= 0) & (np.isfinite(sims[qi, ri]) if sims.size else np.zeros(len(ri), bool))
        qi, ri = qi[ok], ri[ok]
        return pa.table({"query": q.column(key).take(pa.array(qi, pa.int64())), key: r.column(key).take(pa.array(ri, pa.int64())), "score": sims[qi, ri] if sims.size else np.zeros(0), **({unique: r.column(unique).take(pa.array(ri, pa.int64()))} if unique else {})})

    has = lambda df: df.select(*cols).dropna(subset=[key, *columns])
    found = block_pairs(has(queries), has(rows), key).applyInArrow(best, schema)
    if unique:
        first = Window.partitionBy("query", unique).orderBy(F.desc("score"), key)
        found = found.withColumn("_u", F.row_number().over(first)).filter("_u = 1").drop("_u")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", place).filter(F.col("rank") <= n).select("query", key, "score", "rank")


def counted_scores(queries: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], score: Callable, *, digits: int = 4) -> DataFrame:
    """query, score (rounded to so many digits) and n: how many rows have that score for the query, itself left out.

    Scores are counted where they are made, so a query gives as many rows as there are different rounded scores, not as many as there are rows.
    """
    kind = dict(rows.dtypes)[key]

    def count(pair: pa.Table) -> pa.Table:
        q, _, sims = _scored(pair, key, columns, score, None)
        grid = np.round(sims, digits)
        out = [np.unique(line[np.isfinite(line)], return_counts=True) for line in grid]
        times = [len(v) for v, _ in out]
        return pa.table({"query": q.column(key).take(pa.array(np.repeat(np.arange(len(out)), times), pa.int64())), "score": np.concatenate([v for v, _ in out]) if out else np.zeros(0), "n": np.concatenate([c for _, c in out]).astype(np.int64) if out else np.zeros(0, np.int64)})

    has = lambda df: df.select(key, *columns).dropna()
    made = block_pairs(has(queries), has(rows), key).applyInArrow(count, f"query {kind}, score double, n long")
    return made.groupBy("query", "score").agg(F.sum("n").alias("n"))


def first_hit_rank(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """query and r, its rank among all rows (not the query itself; ties by key) of the best one of its label; null if none is.

    Two passes over the pairs of blocks: the best row of the same label, then how many rows come before it.
    """
    kind, cols = _kind(rows, key), [key, vector, label]

    def best(pair: pa.Table) -> pa.Table:
        q, r = side(pair, 0, key), side(pair, 1, key)
        ks, ids = q.column(key).to_numpy(), r.column(key).to_numpy()
        codes = {}
        mine, other = (np.array([-1 - at if x is None else codes.setdefault(x, len(codes)) for x in part.column(label).to_pylist()], dtype=np.int64) for at, part in ((0, q), (1, r)))  # nulls are no label
        qi, ri, score = leaders(Cosines(matrix(q, vector), matrix(r, vector)), 1, lambda i, j: (mine[i] != other[j]) | (ks[i] == ids[j]))
        return pa.table({"query": q.column(key).take(pa.array(qi)), "score": score, "first": r.column(key).take(pa.array(ri))})

    found = block_pairs(queries.select(*cols), rows.select(*cols), key, wide=True).applyInArrow(best, f"query {kind}, score double, first {kind}")
    hits = found.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "first")).alias("b")).select(F.col("query").alias(key), (-F.col("b.s")).alias("_score"), F.col("b.first").alias("_first"))

    def before(pair: pa.Table) -> pa.Table:
        q, r = side(pair, 0, key), side(pair, 1, key)
        ks, ids = q.column(key).to_numpy(), r.column(key).to_numpy()
        score, first = q.column("_score").to_numpy(), q.column("_first").to_numpy()
        measure = Cosines(matrix(q, vector), matrix(r, vector))
        n = counted_before(measure, score, lambda i, j: ids[j] < first[i], same_keys(ks, ids)) if all(measure.size) else np.zeros(len(ks), np.int64)
        return pa.table({"query": q.column(key), "n": n})

    marked = queries.select(key, vector).join(hits, key)
    plain = rows.select(key, vector, F.lit(None).cast("double").alias("_score"), F.lit(None).cast(kind).alias("_first"))
    ranks = block_pairs(marked, plain, key, wide=True).applyInArrow(before, f"query {kind}, n long")
    every = queries.select(F.col(key).alias("query"))
    return every.join(ranks.groupBy("query").agg((F.sum("n") + 1).alias("r")), "query", "left")


def top_pairs(rows: DataFrame, key: str, vector: str, other_than: str, n: int) -> DataFrame:
    """The n pairs of different `other_than` with the largest cosine, a < b, exactly.

    Each pair of blocks returns the n best of its own, and those are ordered.
    """
    kind, cols = _kind(rows, key), [key, vector, other_than]

    def best(pair: pa.Table) -> pa.Table:
        q, r = side(pair, 0, key), side(pair, 1, key)
        ks, ids = q.column(key).to_numpy(), r.column(key).to_numpy()
        codes = {}
        own, other = (np.array([codes.setdefault(x, len(codes)) for x in part.column(other_than).to_pylist()], dtype=np.int64) for part in (q, r))
        measure, same_block = Cosines(matrix(q, vector), matrix(r, vector)), bool(len(pair)) and pair.column("_q")[0].as_py() == pair.column("_r")[0].as_py()
        found, least = [np.zeros(0, ks.dtype), np.zeros(0, ks.dtype), np.zeros(0)], -np.inf
        for i, parts in tiles(measure.size):
            for j in parts:
                if same_block and j.stop <= i.start:
                    continue  # below the diagonal
                sims, edge = measure.rough(i, j), least - measure.slack
                if np.isinf(least):
                    pairs = (ks[i, None] < ids[None, j]) if same_block else (ks[i, None] != ids[None, j])
                    sims = np.where(pairs & (own[i, None] != other[None, j]), sims, -np.inf)
                    edge = np.partition(sims.ravel(), -n)[-n] - 2 * measure.slack if sims.size > n else edge
                qi, ri = np.divmod(np.flatnonzero(sims >= edge), j.stop - j.start)
                qi, ri = qi + i.start, ri + j.start
                ok = (own[qi] != other[ri]) & ((ks[qi] < ids[ri]) if same_block else (ks[qi] != ids[ri]))
                if not ok.any():
                    continue
                qi, ri = qi[ok], ri[ok]
                x, y = ks[qi], ids[ri]
                found = [np.concatenate(z) for z in zip(found, (np.minimum(x, y), np.maximum(x, y), exact_at(measure, i, j, qi, ri)), strict=True)]
                order = np.lexsort((found[1], found[0], -found[2]))[:n]
                found = [z[order] for z in found]
                least = found[2][-1] if len(order) == n else least
        return pa.table(dict(zip(("a", "b", "cosine"), found, strict=True)))

    found = block_pairs(rows.select(*cols), rows.select(*cols), key, upper=True, wide=True).applyInArrow(best, f"a {kind}, b {kind}, cosine double")
    return found.orderBy(F.desc("cosine"), "a", "b").limit(n)


def retrieval_metrics(scored: DataFrame, query: str, hit_rank: str, at: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Recall at k, mean reciprocal rank and median rank of one row a query with the rank of its first hit (null: none)."""
    rank = F.col(hit_rank)
    return scored.agg(
        F.count(query).alias("queries"),
        *[F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in at],
        F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"),
    ).join(F.broadcast(exact_quantiles(scored, hit_rank, [0.5]).withColumnRenamed("q0", "median_rank")), how="left")  # a row each
