"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes log counts of hashed byte trigrams and a few bucketed statistics, weighted by inverse document
frequency, and is projected on the leading singular vectors of a labelled sample. The labelled vectors, a bounded number,
go to every task; each block of documents is multiplied with all of them exactly, and the nearest vote
with a weight that falls with their angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Hashed trigram terms; statistics follow, BUCKETS terms each.
TRIGRAMS, STATISTICS, BUCKETS = 4096, 6, 16
TERMS = TRIGRAMS + STATISTICS * BUCKETS
#: Weight of a statistic's term beside the trigrams.
STATISTIC_WEIGHT = 4.0


def terms(text: bytes) -> np.ndarray:
    """A text's raw term weights; an empty text has its statistics only."""
    a = np.frombuffer(text, np.uint8)
    out = np.zeros(TERMS, np.float32)
    distinct = 1.0
    if len(a) >= 3:
        step = 1 << 20
        counts = np.zeros(TRIGRAMS, np.int64)
        for at in range(0, len(a) - 2, step):
            b = a[at : at + step + 2].astype(np.uint32)
            h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
            counts += np.bincount(h >> np.uint32(20), minlength=TRIGRAMS)
        distinct = np.count_nonzero(counts) / min(len(a) - 2, TRIGRAMS)
        out[:TRIGRAMS] = np.log1p(counts)
    words = text.split()
    n, w = max(1, len(a)), max(1, len(words))
    upper = np.count_nonzero((a >= 65) & (a <= 90)) / n
    odd = np.count_nonzero(((a > 32) & (a < 48)) | ((a > 57) & (a < 65)) | ((a > 90) & (a < 97)) | ((a > 122) & (a < 127))) / n
    lines = text.split(b"\n")
    values = (min(1.0, upper * 2), min(1.0, odd * 3), len(set(words)) / w, distinct, min(1.0, np.log1p(len(a)) / 14), len(set(lines)) / len(lines))
    for k, value in enumerate(values):
        at = value * (BUCKETS - 1)
        low = int(at)
        base = TRIGRAMS + k * BUCKETS + low
        out[base] += STATISTIC_WEIGHT * (1 - (at - low))
        if low + 1 < BUCKETS:
            out[base + 1] += STATISTIC_WEIGHT * (at - low)
    return out


#: Similarities this near are equal.
ROUNDING = 1e-6


@dataclass
class QualityModel:
    """idf and singular vectors (TERMS x rank), unit vectors of the labelled sample and their labels."""

    weights: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    power: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        z = rows @ self.weights
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, z: np.ndarray) -> np.ndarray:
        """The share of label 1 among the k nearest labelled vectors, and what ties with the k-th, by similarity; 0.5 if there are none."""
        n = len(self.labels)
        if not n:
            return np.full(len(z), 0.5)
        s = z @ self.vectors.T
        if self.k < n:
            # All that are as near as the k-th vote, so that ties need no order; products of equal vectors may differ by rounding.
            s = np.where(s >= -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1 : self.k] - ROUNDING, s, 0)
        rows, near = np.nonzero(s > 0) if self.k < n else np.divmod(np.arange(s.size), n)
        w = np.maximum(s[rows, near], 1e-6).astype(np.float64) ** self.power
        total = np.bincount(rows, w, len(s))
        return np.where(total > 0, np.bincount(rows, w * self.labels[near], len(s)) / np.maximum(total, 1e-300), 0.5)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, usable: Column, per_class: int) -> DataFrame:
    """Up to per_class ids of either label, those of smallest hash; an id labelled twice counts by its largest label."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & usable).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    parts = [one.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    usable: Column | None = None,
    per_class: int = 3000,
    rank: int = 64,
    k: int = 15,
    power: float = 8.0,
) -> QualityModel:
    """Fits on at most 2 * per_class labelled documents whose id meets ``usable``; this bound holds at any input size.

    Nulls among ids or labels are not learnt from; without any label the model scores 0.5.
    """
    sample = labelled_sample(labels, id_col, label_col, F.lit(True) if usable is None else usable, per_class)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [terms(x) for x in pdf["text"]]
            at = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "at": [i.astype("<u2").tobytes() for i in at], "value": [r[i].astype("<f4").tobytes() for i, r in zip(at, rows)]})

    got = (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
        .join(F.broadcast(sample), "id")
        .mapInPandas(sparse, f"id {sample.schema['id'].dataType.simpleString()}, label int, at binary, value binary")
        .toPandas()
        .sort_values(["id", "at"], ignore_index=True)
    )
    n = len(got)

    def dense() -> np.ndarray:
        x = np.zeros((n, TERMS), np.float32)
        for i in range(n):
            x[i, np.frombuffer(got["at"][i], "<u2")] = np.frombuffer(got["value"][i], "<f4")
        return x

    seen = np.zeros(TERMS, np.int64)
    for at, value in zip(got["at"], got["value"]):
        seen[np.frombuffer(at, "<u2")] += np.frombuffer(value, "<f4") != 0
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32)
    idf[TRIGRAMS:] = 1
    # The driver holds the sample once, 100 MB at the default bound; it is scaled in place and made anew for the last product.
    scaled = dense()
    scaled *= idf
    for at in range(0, n, 256):
        rows = scaled[at : at + 256]
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    # Randomised subspace iteration for the leading right singular vectors.
    rng = np.random.default_rng(0)
    basis = rng.standard_normal((TERMS, min(rank + 16, TERMS))).astype(np.float32)
    for _ in range(3):
        basis = np.linalg.qr(scaled.T @ (scaled @ basis))[0] if n else np.linalg.qr(basis)[0]
    if n:
        small = np.linalg.svd(scaled @ basis, full_matrices=False)[2]
        basis = basis @ small.T
    del scaled
    model = QualityModel(np.ascontiguousarray(idf[:, None] * basis[:, :rank]), np.zeros((0, rank), np.float32), got["label"].to_numpy(np.float64) if n else np.zeros(0), k, power)
    model.vectors = model.project(dense()) if n else model.vectors
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of docs and ``score_col`` (0 to 1; an existing column of that name is replaced).

    Every text is scored whole, null as empty; repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 6000 x 64 and TERMS x 64 floats at the default bounds

    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in texts:
            parts = []
            for at in range(0, len(s), 512):
                rows = np.stack([terms(x) for x in s.iloc[at : at + 512]])
                parts.append(m.vote(m.project(rows)))
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(score_col, F.pandas_udf(udf, "double")(text_of(text_col).cast("binary")))
