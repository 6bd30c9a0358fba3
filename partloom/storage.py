"""Tables in the folder that driver and executors share: lineage is cut there, and a lost executor costs nothing.

A result is lazy and may read such tables for as long as its session lives; so what is not deleted before is deleted
when the driver ends. A job that runs many queries can end them sooner with workspace()."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Open workspaces, the innermost last; each thread has its own.
_workspaces: ContextVar[tuple[str, ...]] = ContextVar("workspaces", default=())

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; one of its own only where driver and executors are one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="partloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def folder(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder, in the workspace that is open or else for until_exit()."""
    inner = _workspaces.get()
    return f"{inner[-1] if inner else scratch(spark) + '/partloom'}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Shuffle files of what is written inside go when it is written; else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def save(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder, compressed by ``codec``, and read it back."""
    spark = df.sparkSession
    path = folder(spark, tag)
    with passing_shuffles(spark):
        df.write.parquet(path, compression=codec)
    if not _workspaces.get():
        until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._partloom_path = path
    return out


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def until_exit(spark: SparkSession, path: str) -> None:
    """Have what is at ``path`` deleted when the driver ends."""
    files, p = _at(spark, path)
    files.deleteOnExit(p)


def _delete(spark: SparkSession, path: str) -> None:
    files, p = _at(spark, path)
    files.delete(p, True)
    files.cancelDeleteOnExit(p)


def discard(*frames: DataFrame) -> None:
    """Delete tables that save() wrote; for intermediates that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_partloom_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def workspace(spark: SparkSession):
    """What save() writes inside is deleted at the end. Results are lazy: write what shall stay before, with kept()."""
    path = f"{scratch(spark)}/partloom/work-{uuid.uuid4().hex}"
    token = _workspaces.set((*_workspaces.get(), path))
    try:
        yield
    finally:
        _workspaces.reset(token)
        _delete(spark, path)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """save() beside the workspace that is open, if one is, so that the table outlives it."""
    token = _workspaces.set(_workspaces.get()[:-1])
    try:
        return save(df, tag)
    finally:
        _workspaces.reset(token)
