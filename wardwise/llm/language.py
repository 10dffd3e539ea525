"""Language by the nearest of several centroids.

A text is a TF-IDF vector of byte trigrams of its lower-case form (digits and
ASCII signs count as blanks), hashed to ``WIDTH`` places, with logarithmic term
counts and length one. Training vectors of each language are clustered by cosine;
a text takes the language of the nearest centroid. It is ``rejected`` if it lies
farther from that centroid than nearly all training texts of the cluster.

Learning uses a bounded sample: ``SAMPLE`` documents in all, shared evenly by the
languages (the ``SAMPLE`` most frequent, should there be more), chosen by a hash
of the id. Prediction is one narrow pass over whole texts.

Null texts and texts without a letter are ``und`` with score 0, and so is every
text if there is nothing to learn from. Rows without a language teach nothing.
Repeated rows give repeated rows; a null id is not held out and teaches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from wardwise.llm.common import bucket_of, per_batch

UNDETERMINED = "und"
WIDTH = 8192
SAMPLE, PER_LANGUAGE, CENTROIDS = 2400, 400, 4
REJECTED_SHARE = 0.005
LETTER = re.compile(r"[^\W\d_]")  # and some signs that are numbers, which isalpha() tells apart
BLANKS = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
ROWS = 128  # texts per matrix product


def counts(text: str) -> np.ndarray:
    """How often each hashed trigram occurs, blanks around the text included."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(BLANKS) + b"  ", "u1").astype("u4")
    codes = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    codes ^= codes >> np.uint32(15)
    return np.bincount((codes * np.uint32(0x2C1B3C6D)) >> np.uint32(19), minlength=WIDTH)


def weigh(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts to unit vectors."""
    vectors = np.log1p(found.astype("f4")) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True, eq=False)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    nearness: np.ndarray  # least cosine that is not rejected, of each centroid


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, started from far points."""
    centers = [vectors.mean(0)]
    while len(centers) < min(k, len(vectors)):
        centers.append(vectors[np.argmin(np.max(vectors @ np.array(centers).T, axis=1))])
    centers = np.array(centers)
    for _ in range(rounds):
        own = np.argmax(vectors @ centers.T, axis=1)
        centers = np.array([vectors[own == c].sum(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    return centers, np.argmax(vectors @ centers.T, axis=1)


def fit(found: np.ndarray, languages: list[str], k: int = CENTROIDS) -> Model:
    """From rows of counts and their languages."""
    idf = (np.log((1 + len(found)) / (1 + (found > 0).sum(0))) + 1).astype("f4")
    vectors, own = weigh(found, idf), np.array(languages, object)
    centroids, names, nearness = [], [], []
    for language in sorted(set(languages)):
        mine = vectors[own == language]
        centers, nearest = _cluster(mine, k)
        for c, center in enumerate(centers):
            near = (mine[nearest == c] @ center) if (nearest == c).any() else np.ones(1)
            centroids.append(center)
            names.append(language)
            nearness.append(np.quantile(near, REJECTED_SHARE))
    return Model(idf, np.array(centroids, "f4"), names, np.array(nearness))


def learn(df: DataFrame, folds: int = 4, held_out: int = 2) -> Model | None:
    """Fit on a bounded sample of rows with a language outside the held-out fold."""
    ids = df.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
        & (bucket_of("doc_id", folds) != held_out)
    ).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    frequent = ids.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(SAMPLE).collect()
    if not frequent:
        return None
    each = min(PER_LANGUAGE, SAMPLE // len(frequent))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    chosen = chosen.where(F.col("_lang").isin([r._lang for r in frequent])).select("_id", "_lang").distinct()
    schema = StructType().add("_id", ids.schema["_id"].dataType).add("_lang", "string").add("found", "binary")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.minimum(counts(t.as_py()), 65535).astype("<u2").tobytes() for t in batch.column("_text")]
        return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_lang"), pa.array(found, pa.binary())], schema.names)

    rows = (
        df.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        .where(F.col("_text").isNotNull())
        .join(F.broadcast(chosen), "_id")  # at most SAMPLE rows
        .groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
        .mapInArrow(per_batch(count), schema).collect()
    )
    rows.sort(key=lambda r: (r._id, r._lang))
    return fit(np.array([np.frombuffer(r.found, "<u2") for r in rows]), [r._lang for r in rows])


def predict(df: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected``."""
    kept = df.drop("lang_pred", "score", "rejected")
    schema = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few centroids per sampled language

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        n = batch.num_rows
        languages, scores, rejected = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
        texts = [(i, t) for i, t in enumerate(batch.column(column).to_pylist()) if t and any(m.group().isalpha() for m in LETTER.finditer(t))]
        for at in range(0, len(texts) if model else 0, ROWS):
            part = texts[at : at + ROWS]
            near = weigh(np.array([counts(t) for _, t in part]), model.idf) @ model.centroids.T
            best = np.argmax(near, axis=1)
            for (i, _), b, s in zip(part, best, near[np.arange(len(part)), best]):
                languages[i], scores[i], rejected[i] = model.languages[b], min(max(float(s), 0.0), 1.0), s < model.nearness[b]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(languages, pa.string()), pa.array(scores), pa.array(rejected)], schema.names
        )

    return kept.mapInArrow(per_batch(one), schema)


def predicted(df: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``documents``."""
    model = learn(df, folds, held_out)
    out = F.coalesce(bucket_of("doc_id", folds) == held_out, F.lit(False))
    return predict(df.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "rejected"
    )
