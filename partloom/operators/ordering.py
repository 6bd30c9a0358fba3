"""Places in a total order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Adds ``name``, from 1, in the order of ``order``, which must tell all rows apart.

    Rows are dealt by ranges of the order and numbered within each range; a range starts after the sum of those
    before it. The ranged rows are written first: a range's bounds are sampled, so they must be the same for the
    counts and for the rows. The counts are one row a range."""
    columns = rows.columns
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    local = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = save(ranged.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.shiftright(local, 33).alias("range"), local.bitwiseAND((1 << 33) - 1).alias("nth")), "ranged")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return ranged.join(before, "range").select("row.*", (F.col("before") + F.col("nth") + 1).alias(name))
