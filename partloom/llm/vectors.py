"""Vector columns: which rows take part."""

from __future__ import annotations

from pyspark.sql import functions as F


def usable(column: str):
    """Whether a vector is there, holds something, and holds neither null nor non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))
