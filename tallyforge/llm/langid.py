"""Language identification by nearest centroid.

A text is lower-cased, everything but letters becomes a space, and its byte bigrams and trigrams are hashed to DIMS dimensions.
The vector is log(1 + count) * idf, normalised. Each language has several centroids, found by spherical k-means on a
bounded sample; a text takes the language of the centroid with the largest cosine. A text that is farther
from every centroid than texts of its length are from theirs is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import give_back, table

DIMS = 4096
NONE = "und"
#: Bytes of lower-cased text: ASCII letters and all bytes beyond ASCII stay, the rest part words.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
ASCII_LETTER = re.compile(r"[A-Za-z]")
CHUNK = 256  # texts of which the vectors are held at once

GUESS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
GUESS_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def counts(text: str | None) -> np.ndarray:
    """How often the text's n-grams fall in each dimension."""
    raw = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(LETTERS) + b" ", dtype=np.uint8)
    b = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIMS, dtype=np.int64)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(3) + b[2:] * np.uint32(0xC2B2AE3D)
    half = DIMS // 4  # bigrams take a quarter of the dimensions
    return np.concatenate([np.bincount(_mix(two) % half, minlength=half), np.bincount(_mix(three) % (DIMS - half), minlength=DIMS - half)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # a row each
    langs: list[str]  # of the centroids
    floor: np.ndarray  # least cosine that is accepted, by bits of the number of n-grams

    def guess(self, texts: list[str | None]) -> list[dict]:
        out = []
        for at in range(0, len(texts), CHUNK):
            part = texts[at : at + CHUNK]
            tf = np.stack([counts(t) for t in part])
            if self.langs:
                sims = np.clip(_vectors(tf, self.idf) @ self.centroids.T, 0, 1)
                best = sims.argmax(axis=1)
            for i, t in enumerate(part):
                if not self.langs or not has_letter(t):
                    out.append({"lang": NONE, "score": 0.0, "accepted": False})
                    continue
                score = float(sims[i, best[i]])
                bits = min(int(tf[i].sum()).bit_length(), len(self.floor) - 1)
                out.append({"lang": self.langs[best[i]], "score": score, "accepted": score >= self.floor[bits]})
        return out


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-first rows; empty clusters go."""
    centres = v.mean(axis=0, keepdims=True)
    while len(centres) < min(k, len(v)):
        centres = np.vstack([centres, v[(v @ centres.T).max(axis=1).argmin()][None]])
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1)
        centres = np.stack([v[own == j].mean(axis=0) for j in range(len(centres)) if (own == j).any()])
        norm = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(norm > 0, norm, 1)
    return centres


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample_rows: int = 2400, clusters: int = 4, slack: float = 0.5) -> Model:
    """Learn from the texts and languages of all rows of `labelled` whose language isn't null.

    The document frequencies are of all those rows. The centroids are of a sample of about sample_rows of
    them (the bound of what reaches the driver, DIMS counts a row), chosen by a hash of the text, evenly over languages.
    slack: the share of the least cosine among sampled texts of a length at which longer distances are rejected.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per_lang)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column("text"):
                df += counts(t.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMS + 1), pa.int32()), pa.array([*df.tolist(), n], pa.int64())], ["dim", "df"])

    df = np.zeros(DIMS + 1)
    for r in rows.select("text").mapInArrow(frequencies, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect():
        df[r["dim"]] = r["df"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    share = max(1, sample_rows // max(1, len(langs)))
    wanted = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, share / per_lang[k])))]) if langs else F.lit(None)
    chosen = rows.withColumn("h", F.xxhash64(F.lit(3), "text")).filter(F.pmod("h", F.lit(1 << 30)) < F.element_at(wanted, F.col("lang")) * (1 << 30)) if langs else rows.withColumn("h", F.lit(0)).limit(0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf = [counts(t.as_py()).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(tf, pa.binary())], ["lang", "h", "tf"])

    sample = chosen.mapInArrow(vectors, "lang string, h long, tf binary").dropDuplicates(["lang", "h"]).collect()
    centres, names, near = [], [], []
    for name in langs:
        mine = sorted((r["h"], bytes(r["tf"])) for r in sample if r["lang"] == name)[: 2 * share]
        if not mine:
            continue
        tf = np.stack([np.frombuffer(b, dtype=np.int32) for _, b in mine])
        tf = tf[tf.sum(axis=1) > 0]
        if not len(tf):
            continue
        v = _vectors(tf, idf)
        own = _kmeans(v, clusters)
        centres.append(own)
        names += [name] * len(own)
        near += zip(tf.sum(axis=1).tolist(), (v @ own.T).max(axis=1).tolist(), strict=True)
    least = np.full(40, np.inf)
    for n, sim in near:
        least[int(n).bit_length()] = min(least[int(n).bit_length()], sim)
    # A longer text is nearer its centroid: what is far enough for a length is so for all shorter ones.
    floor = slack * np.minimum.accumulate(least[::-1])[::-1]
    floor = np.minimum(floor, np.where(np.isfinite(floor), floor, -1).max())
    if near:
        first = min(int(n).bit_length() for n, _ in near)
        floor[:first] = 0  # no sampled text is as short
    return Model(idf, np.vstack(centres).astype(np.float32) if centres else np.zeros((0, DIMS), np.float32), names, np.where(np.isfinite(floor), floor, 0))


def identify(docs: DataFrame, model: Model, *, text: str = "text", into: str = "language") -> DataFrame:
    """docs and a struct, named by `into`: lang, score (the largest cosine, 0 to 1), accepted.

    Each text is judged alone and whole. A null text, one without a letter, and any text where the model
    has no language get `und`, 0 and false. Equal texts get equal results. A column of docs of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages x DIMS floats

    @F.arrow_udf(GUESS)
    def guess(t: pa.Array) -> pa.Array:
        model = shared.value
        out = pa.array([g for at in range(0, len(t), CHUNK) for g in model.guess(t.slice(at, CHUNK).to_pylist())], type=GUESS_ARROW)
        give_back()
        return out

    return docs.withColumn(into, guess(F.col(text).cast("string")))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    """op3: learn from the documents that aren't held out, then predict all."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.accepted").alias("accepted"))
