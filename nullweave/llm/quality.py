"""Quality classifier.

Method: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot
products of a text's n-gram frequencies and the weights.

Tokens are lower-cased runs of letters and digits or of ASCII punctuation; a
token equal to the one before becomes the token "=", so that repetition is seen
whatever the word.  Features are 1- and 2-grams hashed to 2^18 buckets, valued
by their share among the text's n-grams.

The training sample is bounded (`train_rows`, a documented parameter): of the
labels 0 or 1 of documents to learn from, those with the smallest hashes of
their ids.  Scoring covers every row.

Defined cases: a null or empty text has no features and scores by the bias
alone; labels that are null, or whose document is missing, teach nothing; with
no usable label (or one class only) every text scores the share of label 1
(0.5 if there is none); repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, hash_words, mix, plain, trimmed

BITS = 18
SCALE = 8.0
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")


def features(text: str | None, cache) -> np.ndarray:
    """Bucket of every 1- and 2-gram of a text, in text order."""
    tokens = _TOKEN.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    h[1:][h[1:] == h[:-1]] = np.uint64(0x3D)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mix(np.concatenate([h, pairs])) >> np.uint64(64 - BITS)).astype(np.int32)


def _sparse(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx, n = np.unique(buckets, return_counts=True)
    return idx, (n * (SCALE / max(1, len(buckets)))).astype(np.float32)


def ftrl(rows, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """Weights (the bias last) after FTRL-proximal passes over rows of (distinct buckets, their shares, label)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in rows:
            i, x = np.append(i, 1 << BITS), np.append(x, 1.0)
            zi, ni = z[i], n[i]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    return weight(z, n).astype(np.float32)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 12_000, epochs: int = 6) -> np.ndarray:
    """Weights learned from at most `train_rows` labelled documents, in one task of bounded size."""
    sample = plain(labels, doc_id="doc_id", y=label).where("y in (0, 1) and doc_id is not null")
    sample = sample.join(plain(documents, doc_id="doc_id"), "doc_id", "left_semi").select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("k"))
    sample = sample.orderBy("k", "doc_id", "y").limit(train_rows)
    texts = plain(documents, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id")

    def extract(batches):
        import pyarrow as pa

        cache = hash_words()
        for part in blocks(batches):
            own = [_sparse(features(t, cache)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("y"), pa.array([i.tobytes() for i, _ in own], pa.binary()), pa.array([x.tobytes() for _, x in own], pa.binary())],
                ["k", "y", "buckets", "shares"],
            )
            cache.trim()

    extracted = texts.select("k", "y", "text").mapInArrow(trimmed(extract), "k bigint, y int, buckets binary, shares binary")

    def fit(_, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["k", "buckets", "shares", "y"])
        ones = float(pdf.y.mean())
        if ones in (0.0, 1.0):
            w = np.zeros((1 << BITS) + 1, np.float32)
            w[-1] = 10 * (2 * ones - 1)
        else:
            w = ftrl([(np.frombuffer(b, np.int32), np.frombuffer(x, np.float32), float(y)) for b, x, y in zip(pdf.buckets, pdf.shares, pdf.y)], epochs)
        return pd.DataFrame({"weights": [w.tobytes()]})

    found = extracted.groupBy(F.lit(0).alias("one")).applyInPandas(fit, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(documents: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """All columns of `documents` and the score (0 to 1) of every whole text; a column of its name is replaced."""
    name, documents = "text", documents.drop(column)
    schema = T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        cache = hash_words()
        for part in blocks(batches, name):
            got = []
            for t in part.column(name).to_pylist():
                b = features(t, cache)
                x = float(weights[b].sum(dtype=np.float64)) * SCALE / max(1, len(b)) + float(weights[-1])
                got.append(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))
            cache.trim()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, column])

    return documents.mapInArrow(trimmed(run), schema)
