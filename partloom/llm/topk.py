"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size, each sent to all candidates. A pass scores every candidate against
the block and counts scores in bins; only a task's topmost bins up to its own kth score can hold a query's kth
score, so a task reports those alone. Summed over tasks, the counts tell which bin holds each query's kth score;
the next pass counts within that bin in finer bins, until bins are single values. A last pass returns the scores
above the kth, and of those equal to it as many as are missing, smaller ids first. The driver sees one row a query
of the block and pass; the results of a block are written before the next block begins, so plans stay as they are
however many blocks there are.

Scores are integer inner products, computed exactly: in doubles while products stay below 2**53, in 64-bit
integers while they stay below 2**63, else in integers of any length. Every query has bounds of its own, from its
length and the longest candidate. Scores are compared as unsigned numbers from the least long on.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; components of
2**62 and more in size count as 2**62; a score that no long holds counts as the nearest long; a query is
compared with the vectors of its length only; rows with a null id take no part; rows that repeat an id are
candidates each, as a query the least of their vectors counts, and a query's own id is none of its candidates; no
queries or an empty table give no rows; other columns do not matter.
"""

from __future__ import annotations

import uuid
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import discard, lean, save, scratch, tune
from .vectors import usable

BINS = 1 << 12
LARGEST = 1 << 62
TOP = np.uint64(1 << 63)
CELLS = 1 << 22  # scores that a task holds at once


def whole_numbers(vector: str, factor: float = 256.0):
    """floor(factor * x) of each component, x as a double."""
    most = F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * factor))))


def _squares(v: str):
    """Sum of squares as a double, a little too large rather than too small."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) * 1.000001


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, candidates) inner products as signed 64-bit integers."""
    if not x.shape[1]:
        return np.zeros((len(q), len(x)), np.int64)
    big = int(np.abs(q).max(initial=0)) * x.shape[1]
    each = np.abs(x).max(axis=1, initial=0)
    if big * int(each.max(initial=0)) < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    out = np.empty((len(q), len(x)), np.int64)
    small = each < -(-(1 << 53) // max(big, 1))
    long = each >= -(-(1 << 63) // max(big, 1))
    out[:, small] = (q.astype(np.float64) @ x[small].astype(np.float64).T).astype(np.int64)
    out[:, ~small & ~long] = q @ x[~small & ~long].T
    if long.any():
        exact = q.astype(object) @ x[long].astype(object).T
        out[:, long] = np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return out


def _unsigned(score: np.ndarray) -> np.ndarray:
    return score.view(np.uint64) ^ TOP


def _blocks(batches, length: int, queries: int):
    step = max(1, CELLS // queries)
    for b in batches:
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part.column(0).to_numpy(), flat.reshape(-1, length)


def _pass(candidates: DataFrame, shared, k: int, length: int) -> DataFrame:
    """(q, bin, ahead): the bin of each query that holds its kth score, and the scores in the bins above it; a null bin
    where there are fewer than what is missing."""

    @lean
    def run(batches):
        s = shared.value
        for ids, x in _blocks(batches, length, len(s["x"])):
            at = _unsigned(_scores(s["x"], x))
            ahead = at - s["low"][:, None]
            bin_ = (ahead // s["width"][:, None]).astype(np.int64)
            bin_[(at < s["low"][:, None]) | (ahead > s["last"][:, None]) | (ids[None, :] == s["ids"][:, None])] = -1
            least = np.partition(bin_, -k, axis=1)[:, -k] if bin_.shape[1] > k else np.zeros(len(bin_), np.int64)
            r, c = np.nonzero(bin_ >= np.maximum(least, 0)[:, None])
            u, n = np.unique(r * BINS + bin_[r, c], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u // BINS), pa.array(u % BINS), pa.array(n)], names=["q", "bin", "n"])

    counted = candidates.mapInArrow(run, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    missing = F.element_at(F.lit(shared.value["missing"].tolist()), (F.col("q") + 1).cast("int"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))))
    enough = F.col("upto") >= missing
    return upto.groupBy("q").agg(F.max(F.when(enough, F.col("bin"))).alias("bin"), F.coalesce(F.max(F.when(~enough, F.col("upto"))), F.lit(0)).alias("ahead"))


def _kth(candidates: DataFrame, block: dict, k: int, length: int, longest: int) -> None:
    """Adds to ``block`` each query's kth score (unsigned), how many scores equal to it are wanted, and whether there is
    a kth at all; where there is none, all scores are wanted."""
    spark, m = candidates.sparkSession, len(block["ids"])
    bound = [min((isqrt(sum(int(c) ** 2 for c in v)) + 1) * longest, (1 << 63) - 1) for v in block["x"]]
    block["low"] = np.array([(1 << 63) - b for b in bound], np.uint64)
    block["last"] = np.array([2 * b for b in bound], np.uint64)
    block["missing"], some = np.full(m, k, np.int64), np.ones(m, bool)
    while True:
        block["width"] = block["last"] // np.uint64(BINS) + np.uint64(1)
        shared = spark.sparkContext.broadcast(block)  # at most ``block_rows`` vectors
        told = {q: (b, a) for q, b, a in _pass(candidates, shared, k, length).collect()}  # a row a query of the block
        shared.destroy()
        for q in np.flatnonzero(some):
            b, a = told.get(q, (None, 0))
            if b is None:
                some[q] = False
                block["last"][q] = 0
                continue
            start = np.uint64(b) * block["width"][q]
            block["low"][q] += start
            block["last"][q] = min(block["width"][q] - np.uint64(1), block["last"][q] - start)
            block["missing"][q] -= a
        if not block["last"].any():
            break
    block["some"] = some


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, id, score) of the k best candidates of each query row; see the module for ties."""
    spark = vectors.sparkSession
    tune(spark)
    ready = lambda df: df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), whole_numbers(vector_col, factor).alias("v"))
    rows = save(ready(vectors), "candidates")
    asked = save(ready(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    longest = {d: isqrt(int(n)) + 1 for d, n in rows.groupBy(F.size("v")).agg(F.max(_squares("v"))).collect()}
    kind = "query_id bigint, rank int, id bigint, score bigint"
    path, some = f"{scratch(spark)}/partloom/top-{uuid.uuid4().hex}", False
    for length, n in sorted(map(tuple, asked.groupBy(F.size("v").alias("n")).count().collect())):
        if length not in longest:
            continue
        of = rows.where(F.size("v") == length)
        # numbered by ranges of ids, so that all blocks but the last are full and a block is read without the others
        own = save(numbered(asked.where(F.size("v") == length), "id"), "numbered-queries")
        for first in range(1, n + 1, block_rows):
            part = own.where(F.col("place").between(first, first + block_rows - 1)).orderBy("id").collect()
            block = {"ids": np.array([r.id for r in part], np.int64), "x": np.array([r.v for r in part], np.int64)}
            _kth(of, block, k, length, longest[length])
            shared = spark.sparkContext.broadcast(block)  # at most ``block_rows`` vectors
            by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
            best = _take(of, shared, length).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            best.select("query_id", "rank", "id", "score").write.mode("append").parquet(path)
            shared.destroy()
            some = True
        discard(own)
    discard(rows, asked)
    return spark.read.schema(kind).parquet(path) if some else spark.createDataFrame([], kind)


def _take(candidates: DataFrame, shared, length: int) -> DataFrame:
    """Scores above each query's kth, and of a batch's scores equal to it as many as are missing at most."""

    @lean
    def run(batches):
        s = shared.value
        for ids, x in _blocks(batches, length, len(s["x"])):
            score = _scores(s["x"], x)
            at, some = _unsigned(score), s["some"][:, None]
            other = ids[None, :] != s["ids"][:, None]
            r, c = np.nonzero(((at > s["low"][:, None]) | ~some) & other)
            tr, tc = np.nonzero((at == s["low"][:, None]) & some & other)
            order = np.lexsort((ids[tc], tr))
            tr, tc = tr[order], tc[order]
            nth = np.arange(len(tr)) - np.searchsorted(tr, tr)
            keep = nth < s["missing"][tr]
            r, c = np.concatenate([r, tr[keep]]), np.concatenate([c, tc[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(s["ids"][r]), pa.array(ids[c]), pa.array(score[r, c])], names=["query_id", "id", "score"])

    return candidates.mapInArrow(run, "query_id bigint, id bigint, score bigint")
