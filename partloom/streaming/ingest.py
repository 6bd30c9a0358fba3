"""Unbounded input: lines that arrive as files or messages, counted into a running bill.

Classification is the batch path's expressions. parts() counts a reference once in its project, in the order of
arrival, for as long as the watermark keeps the project's state. sightings() follows the order of the lines instead:
an earlier line that arrives late takes back what a later one gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.refs import expand
from ..operators.classify import with_class
from ..operators.ingest import TOKEN
from ..plans.reports import append_once


def parts(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(slot, ts, line) stream -> parts (slot, ts, ref, category, value)."""
    rows = lines.withWatermark("ts", delay).where(F.col("line").rlike(TOKEN))
    rows = rows.select("slot", "ts", F.explode(expand(F.upper(F.regexp_extract("line", TOKEN, 1)))).alias("ref"), F.regexp_extract("line", TOKEN, 2).alias("val_raw"))
    rows = rows.dropDuplicatesWithinWatermark(["slot", "ref"])
    return with_class(rows).where("category IS NOT NULL").select("slot", "ts", "ref", "category", "value")


def running_bill(found: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Parts by event-time window."""
    return found.groupBy(F.window("ts", window), "category", "value").agg(F.count(F.lit(1)).alias("qty"))


CHANGES = "slot bigint, ref string, category string, value string, qty bigint"


def _first_of(keep_ms: int):
    """Keeps the least (ordinal, pos) of a reference and what it was, in a state of one row."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = old = state.get if state.exists else None
        last = 0
        for rows in frames:
            last = max(last, int(rows["ms"].max()))
            least = rows.sort_values(["ordinal", "pos"], kind="stable").iloc[0]
            at = (int(least["ordinal"]), int(least["pos"]))
            if held is None or at < held[:2]:
                held = (*at, *(None if pd.isna(least[c]) else least[c] for c in ("category", "value")))
        if held != old:
            state.update(held)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
        if held[2:] != (old[2:] if old else (None, None)):
            given = [(*part, qty) for part, qty in (((old[2:] if old else (None, None)), -1), (held[2:], 1)) if part[0] is not None]
            yield pd.DataFrame([(*key, *g) for g in given], columns=["slot", "ref", "category", "value", "qty"])

    return run


def sightings(lines: DataFrame, delay: str = "1 hour", keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """(slot, ts, ordinal, line) stream -> changes (slot, ref, category, value, qty): 1 for a part, -1 for one taken back.

    Summed, they are the parts that the batch path finds in the same lines, in whatever order the lines arrive: of a
    reference's sightings the least ordinal decides, even where it gives no part. A reference is kept until the
    watermark (``delay`` behind the newest line) has passed its last sighting by ``keep_ms``; lines that come later
    than both are a new sighting. Rows with a null slot or ordinal take no part."""
    rows = lines.withWatermark("ts", delay).where(F.col("line").rlike(TOKEN) & F.col("slot").isNotNull() & F.col("ordinal").isNotNull())
    rows = rows.select("slot", "ts", "ordinal", F.regexp_extract("line", TOKEN, 2).alias("val_raw"), F.posexplode(expand(F.upper(F.regexp_extract("line", TOKEN, 1)))).alias("pos", "ref"))
    rows = with_class(rows).select("slot", "ref", "ts", F.unix_millis("ts").alias("ms"), "ordinal", "pos", "category", "value")
    state = "ordinal bigint, pos bigint, category string, value string"
    return rows.groupBy("slot", "ref").applyInPandasWithState(_first_of(keep_ms), CHANGES, state, "append", GroupStateTimeout.EventTimeTimeout)


def log_feedback(entries: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stream of (ts, rating, text) -> the feedback log; a batch that runs again after a failure adds no row."""
    rows = entries.select(F.col("ts").cast("string").alias("ts"), "rating", "text")
    return rows.writeStream.foreachBatch(lambda batch, n: append_once(batch, path, f"{n:09d}")).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 minute"}).start()
