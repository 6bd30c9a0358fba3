"""Shared plumbing of the corpus operators: tables, byte views and key runs."""

from __future__ import annotations

import sys
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import discard, kept, save, scratch, workspace  # noqa: F401


def named(column: str):
    """A column by its whole name, whatever dots and backticks it holds."""
    from pyspark.sql import functions as F

    return F.col("`" + column.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def tune(spark: SparkSession) -> None:
    """Hand Python at most a thousand texts at a time, unless the session says something else than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def lean(run):
    """A batch function that gives its freed memory back to the system when a task ends: workers live on."""

    @wraps(run)
    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)

    return out


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column, without copying; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    _, offs, data = col.buffers()
    if not len(col) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 18, rows: int = 1 << 30):
    """Row ranges [i, j) of about ``most`` bytes and at most ``rows``, so that work arrays stay in cache and memory."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1), n)
        yield i, j
        i = j


def runs(batches, keys: list[str]):
    """Record batches sorted by ``keys`` -> tables that hold whole key groups (a group is never split)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[b.num_rows - 1].as_py() for k in keys]
        same = np.ones(b.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= b.column(k).to_numpy(zero_copy_only=False) == v
        cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0:
            if held and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
            continue
        yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def npcol(t, name: str) -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(name).to_numpy()


def batch(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=False) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def by_crc(df: DataFrame, column: str, modulus: int):
    """crc32 of a key's decimal text modulo ``modulus``: the fold of a row."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string")) % modulus
