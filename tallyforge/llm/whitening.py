"""Whitening of embeddings by hierarchical SVD merging.

A vector c becomes x = floor(scale * c) + shift, of whole numbers, so counts and sums are exact. The fit list holds each
distinct x once. A task turns its rows of the list into a summary: their number n, their sums, and all singular values and
right singular vectors of the rows less their mean. Two summaries merge without loss: their values times vectors are
stacked, a row sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2) is appended for the shift between the means, and the stack is
decomposed anew. Every summary keeps all dimensions; only the model that the last merge leaves is cut to the components
asked for. Merges form a tree of FAN summaries a task, so no task holds more than FAN times dimension squared doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialize, table

SCALE, SHIFT = 64, 1_000_000
FAN = 8  # summaries that one task merges
CELLS = 1 << 22  # entries that are decomposed at once
SUMMARY = "id long, n long, sums array<long>, s array<double>, vt array<double>"
LIMIT = 2.0**56  # of an entry's size, for x has to fit a long


@dataclass(frozen=True)
class Model:
    """n and sums of the fit list; eigenvalues and unit eigenvectors of its covariance; its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def usable(self) -> np.ndarray:
        """Components whose eigenvalue isn't zero to double precision."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > top * (len(self.sums) * np.finfo(float).eps) ** 2 if top else np.zeros(len(self.values), bool)


def units(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of each entry; null for a null vector and for one with a null, non-finite or huge entry."""
    fine = F.forall(vector, lambda e: F.coalesce(F.abs(e.cast("double")) < LIMIT, F.lit(False)))  # NaN is above all
    return F.when(fine, F.transform(vector, lambda e: F.floor(e.cast("double") * scale) + F.lit(shift).cast("long")))


def matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def summarize(x: np.ndarray) -> tuple:
    """(n, sums, s, vt) of whole-number rows."""
    near = (x - x[0]).astype(np.float64)  # small numbers, exactly
    _, s, vt = np.linalg.svd(near - near.mean(axis=0), full_matrices=False)
    return len(x), x.sum(axis=0), s, vt


def merge(a: tuple, b: tuple) -> tuple:
    """The summary of the rows of both, from their summaries."""
    (na, sa, va, ta), (nb, sb, vb, tb) = a, b
    base = sa // na
    apart = (sa - na * base) / na - (sb - nb * base) / nb
    stack = np.vstack([va[:, None] * ta, vb[:, None] * tb, math.sqrt(na * (nb / (na + nb))) * apart])
    _, s, vt = np.linalg.svd(stack, full_matrices=False)
    return na + nb, sa + sb, s, vt


def _record(nr: int, one: tuple) -> pa.RecordBatch:
    n, sums, s, vt = one
    long, double = pa.list_(pa.int64()), pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([nr]), pa.array([n]), pa.array([sums], long), pa.array([s], double), pa.array([vt.ravel()], double)], ["id", "n", "sums", "s", "vt"])


def _summaries(fit: DataFrame, dimension: int) -> DataFrame:
    """One summary of each partition of fit (x), with the partition's number."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            x = matrix(b.column(0), dimension)
            for at in range(0, len(x), max(1, CELLS // dimension)):
                one = summarize(x[at : at + max(1, CELLS // dimension)])
                held = one if held is None else merge(held, one)
        if held is not None:
            yield _record(TaskContext.get().partitionId(), held)

    return fit.select("x").mapInArrow(local, SUMMARY)


def _merged(summaries: DataFrame, dimension: int) -> DataFrame:
    """One summary, by rounds of merges of FAN each; summaries is a written table."""

    def fold(rows: pa.Table) -> pa.Table:
        held = None
        for r in range(rows.num_rows):
            n, sums, s, vt = (rows.column(c)[r] for c in ("n", "sums", "s", "vt"))
            one = (n.as_py(), np.array(sums.values), np.array(s.values), np.array(vt.values).reshape(-1, dimension))
            held = one if held is None else merge(held, one)
        return pa.Table.from_batches([_record(rows.column("id")[0].as_py() // FAN, held)])

    while summaries.count() > 1:
        groups = summaries.groupBy(F.floor(F.col("id") / FAN).alias("g"))
        summaries = materialize(groups.applyInArrow(lambda t: fold(t), SUMMARY), "summaries")
    return summaries


def _exact(model: Model, x: np.ndarray) -> np.ndarray:
    """n x - S of each row, in whole numbers: 64 bits where they fit, else Python's."""
    base = model.sums // model.n
    away, rest = x - base, model.sums - model.n * base
    if model.n * (float(np.abs(away).max(initial=0)) + 1) >= 2.0**62:
        away, rest = away.astype(object), rest.astype(object)
    return model.n * away - rest


def project(model: Model, x: np.ndarray) -> np.ndarray:
    """Whitened rows; NaN for components without variance."""
    centred = _exact(model, x).astype(np.float64) / model.n
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.usable, centred @ model.vectors.T / np.sqrt(model.values), np.nan)


def deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2; null beyond a long."""
    t = _exact(model, x)
    if t.dtype == object or float(np.abs(t).max(initial=0)) ** 2 * max(1, t.shape[1]) >= 2.0**62:
        t = t.astype(object)
    return [v if v < 1 << 63 else None for v in map(int, (t * t).sum(axis=1))]


def _identity_error(fit: DataFrame, model: Model) -> float | None:
    """Largest entry by size of the covariance of the whitened fit list, less the identity."""
    kept = np.flatnonzero(model.usable)
    if not len(kept):
        return None
    dimension = len(model.sums)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kept) + 1, len(kept)))
        for b in batches:
            w = project(model, matrix(b.column(0), dimension))[:, kept]
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    sums = fit.select("x").mapInArrow(cross, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((len(kept) + 1, len(kept)))
    for r in sums.collect():  # (components + 1) x components numbers
        total[r["i"], r["j"]] = r["v"]
    mean = total[-1] / model.n
    return float(np.abs(total[:-1] / model.n - np.outer(mean, mean) - np.eye(len(kept))).max())


def usual_length(x: DataFrame) -> int:
    """The length above 0 that most x have; of those that as many have, the smallest. 0 if there is none."""
    most = x.groupBy(F.size("x").alias("size")).count().filter("size > 0").orderBy(F.desc("count"), "size").first()
    return most["size"] if most else 0


def fit(df: DataFrame, *, vector: str = "embedding", components: int = 16, scale: int = SCALE, shift: int = SHIFT) -> Model:
    """The whitening of df's vectors. The driver gets the model alone: components + 1 vectors, whatever the rows.

    Vectors that are null, empty, or hold null, non-finite or huge (2**56) entries aren't fitted, nor those of another
    length than most have. A table without others gives a model without components. Repeated vectors count once. A direction
    in which the list doesn't vary has the eigenvalue 0. Other columns aren't looked at.
    """
    x = df.select(units(F.col(f"`{vector}`"), scale, shift).alias("x")).filter("x is not null")
    dimension = usual_length(x)
    if not dimension:
        none = np.zeros(0, dtype=np.int64)
        return Model(0, none, np.zeros(0), np.zeros((0, 0)), 0.0, None)
    listed = materialize(x.filter(F.size("x") == dimension).distinct(), "fit-list")
    whole = _merged(materialize(_summaries(listed, dimension), "summaries"), dimension)
    k = min(components, dimension)
    cut = whole.select("n", "sums", F.slice("s", 1, k).alias("s"), F.slice("vt", 1, k * dimension).alias("vt"), F.aggregate("s", F.lit(0.0), lambda a, e: a + e * e).alias("squares"))
    r = cut.first()
    vectors = np.array(r["vt"]).reshape(-1, dimension)
    values = np.array(r["s"]) ** 2 / r["n"]
    if len(values) < k:  # fewer rows than components: the rest don't vary
        values, vectors = np.concatenate([values, np.zeros(k - len(values))]), np.vstack([vectors, np.zeros((k - len(vectors), dimension))])
    model = Model(r["n"], np.array(r["sums"], dtype=np.int64), values, vectors, r["squares"] / r["n"], None)
    return Model(*[getattr(model, f) for f in ("n", "sums", "values", "vectors", "trace")], _identity_error(listed, model))


def whiten(df: DataFrame, model: Model, *, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT, into: str = "whitened") -> DataFrame:
    """df with the struct `into`: deviation, and whitened, one value for each component of the model.

    Rows that fit() leaves out have a null struct. A component without variance is null in every row, a deviation that no
    long can hold too. A column of df named as `into` is replaced; all others stay as they are. No rows give none.
    """
    dimension, kind = len(model.sums), pa.struct([("deviation", pa.int64()), ("values", pa.list_(pa.float64()))])

    @F.arrow_udf("deviation long, values array<double>")
    def of(x: pa.Array) -> pa.Array:
        out: list = [None] * len(x)
        fits = [i for i, n in enumerate(x.value_lengths().to_pylist()) if n == dimension and n]
        if fits:
            rows = matrix(x.take(pa.array(fits)), dimension)
            for i, d, w in zip(fits, deviations(model, rows), project(model, rows).tolist(), strict=True):
                out[i] = {"deviation": d, "values": [None if math.isnan(v) else v for v in w]}
        return pa.array(out, type=kind)

    named = [F.col(f"`{c}`") for c in df.columns if c != into]
    return df.select(*named, of(units(F.col(f"`{vector}`"), scale, shift)).alias(into))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: a row for each usable vector and component."""
    embeddings = table(spark, sf_dir, "embeddings")
    model = fit(embeddings)
    shares = [float(v) / model.trace if model.trace else None for v in model.values]
    white = whiten(embeddings.select("vec_id", "embedding"), model, into="w").filter("w is not null")
    rows = white.select("vec_id", "w.deviation", F.posexplode("w.values").alias("at", "whitened"))
    explained = F.array(*[F.lit(v).cast("double") for v in shares]) if shares else F.array(F.lit(None).cast("double"))
    error = F.lit(model.identity_error).cast("double").alias("identity_error")
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), error)
