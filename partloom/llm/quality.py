"""Quality scores: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of word characters and runs of signs; features are hashed tokens and token pairs (a token that
repeats the one before it pairs as such, whatever it is) and the magnitude of the token count. A feature's value
is its share of the text's features, so a score is a sparse dot product divided by a length.

Bound: the model is fitted on at most ``fit_rows`` labelled rows (the smallest hashes of their ids).

Defined cases: null and empty texts have the length feature alone and get a score like any other; repeated rows
are scored alike; labels that are null, or of ids that no text has, teach nothing; without labels every score is
0.5; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, text_bytes, tune
from .textvec import lookup, mixed, tokens

TOKENS = lookup([(0x21, 0x2F, 2), (0x30, 0x39, 1), (0x3A, 0x40, 2), (0x41, 0x5A, 1), (0x5B, 0x60, 2), (0x61, 0x7A, 1), (0x7B, 0x7E, 2), (0x80, 0xFF, 1)])
SCALE = 30.0


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, features in the row), rows ascending."""
    rows = len(off) - 1
    h, row = tokens(data, off, TOKENS)
    pair = np.where(h[1:] == h[:-1], np.uint64(1), h[:-1] * np.uint64(3) + h[1:])
    pair_row = row[1:][row[1:] == row[:-1]]
    pair = mixed(pair + np.uint64(0x51ED27))[row[1:] == row[:-1]]
    n = np.bincount(row, minlength=rows)
    size = mixed(np.log2(n + 1).astype(np.uint64) + np.uint64(0xABCD))
    r = np.concatenate([row, pair_row, np.arange(rows)])
    f = np.concatenate([h, pair, size]) >> np.uint64(64 - bits)
    order = np.argsort(r, kind="stable")
    return r[order], f[order].astype(np.int64), np.bincount(r, minlength=rows)


def train(sample: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5) -> np.ndarray:
    """FTRL-proximal over (features, values, label); the last weight is the intercept."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rng = np.random.default_rng(0)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(sample)):
            i, x, y = sample[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 3000, bits: int = 18) -> np.ndarray:
    """Weights learned from the texts whose ids ``labels`` holds."""
    tune(docs.sparkSession)
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    picked = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "y").limit(fit_rows)
    picked = F.broadcast(spark.createDataFrame(picked.collect(), picked.schema).groupBy("id").agg(F.max("y").alias("y")))  # fit_rows at most

    @lean
    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(2))
            for i, j in slices(off):
                r, f, n = features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                u, c = np.unique((r << bits) | f, return_counts=True)
                cut = np.searchsorted(u >> bits, np.arange(j - i + 1))
                ids, val = (u & ((1 << bits) - 1)).astype("<u4"), c.astype("<f4") / n[u >> bits].astype("<f4")
                blobs = [[x[a:e].tobytes() for a, e in zip(cut[:-1], cut[1:], strict=True)] for x in (ids, val)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(x, pa.binary()) for x in blobs)], names=["id", "y", "f", "v"])

    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").select("id", "y", "text")
    got = thin.mapInArrow(run, f"id {kind}, y int, f binary, v binary").collect()
    got = sorted(got, key=lambda r: (r.id, r.f, r.v))[:fit_rows]
    one = 1 << bits
    return train([(np.append(np.frombuffer(r.f, "<u4").astype(np.int64), one), np.append(np.frombuffer(r.v, "<f4").astype(float) * SCALE, 1.0), r.y) for r in got], bits)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed number of weights
    bits = int(len(weights) - 1).bit_length() - 1

    @lean
    def run(batches):
        w = shared.value
        for b in batches:
            data, off = text_bytes(b.column(1))
            out = np.zeros(b.num_rows)
            for i, j in slices(off):
                r, f, n = features(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                dot = np.bincount(r, weights=w[f], minlength=j - i) * SCALE / n + w[-1]
                out[i:j] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["id", "score"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return thin.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
