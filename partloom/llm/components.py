"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    linked = large.join(low, "u")
    return linked.select("u", F.col("m").alias("v")).unionAll(linked.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of any comparable ids -> (node, component): every node that has an edge and is not the
    smallest of its component, with that smallest node. No edges give no rows."""
    now = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _sum(now)
    while mark[0]:
        new = save(_stars(now), "edges")
        after = _sum(new)
        discard(now)
        now, same = new, after == mark
        mark = after
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
