"""Text scan: projects' payloads as numbered, trimmed, non-blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def lines(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """(slot, source, text) -> (slot, source, ordinal, line)."""
    split = payloads.select("slot", "source", F.posexplode(F.split(strip(text), "\n")).alias("n", "raw"))
    return split.select("slot", "source", F.struct(F.lit(0).alias("phase"), F.col("n").cast("bigint").alias("at")).alias("ordinal"), strip("raw").alias("line")).where("line <> ''")


def read(spark, path: str) -> DataFrame:
    """Whole files, each a project named by its file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(F.xxhash64("path").alias("slot"), F.element_at(F.split("path", "/"), -1).alias("source"), F.col("value").alias("payload"))
