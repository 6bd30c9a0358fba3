"""All inputs of a run at once: each slot by its method, one table of events, statistics and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty, strip
from ..operators import ingest
from ..sources import csv, dispatch, pdf, urls
from ..storage import save

#: What orders a slot's events, whatever its kind.
ORDER = ["phase", "k0", "k1", "k2"]


def _placed(events: DataFrame) -> DataFrame:
    have = events.schema["ordinal"].dataType.names
    fields = [F.col(f"ordinal.{n}").cast("bigint") for n in have] + [F.lit(0).cast("bigint")] * (len(ORDER) - len(have))
    return events.withColumn("ordinal", F.struct(*[f.alias(n) for f, n in zip(fields, ORDER, strict=True)]))


def _fetched(projects: DataFrame, reader, timeout: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slots by address (their payload, where no path says that it is the content already) -> all slots with their
    content in place, the pages of PDFs among it, and errors. Each address is fetched once."""
    address = (F.col("method") == "From URL") & F.col("path").isNull() & nonempty(strip(F.coalesce("payload", F.lit("")))).isNotNull()
    by_address = F.coalesce(address, F.lit(False))
    got = save(urls.fetched(projects.where(by_address).select("slot", "source", F.col("payload").alias("url")), timeout), "fetched")
    texts = got.where("text IS NOT NULL").select("slot", "source", F.lit("From URL").alias("method"), F.col("text").alias("payload"), F.col("url").alias("path"))
    pages = pdf.extract(got.where("content IS NOT NULL"), reader)
    return projects.where(~by_address).select(*texts.columns).unionByName(texts), save(pages, "pages"), got.where("error IS NOT NULL").select("slot", "error")


def take_in(projects: DataFrame, pages: DataFrame | None = None, fetch: bool = False, reader=pdf.plumbed, timeout: float = urls.TIMEOUT) -> dict[str, DataFrame]:
    """``projects`` (slot, source, method, payload, path); ``pages`` of the slots that are PDFs (see sources.pdf). With
    ``fetch``, slots ``From URL`` without a path have an address as payload, and tasks fetch it; ``reader`` reads PDFs.

    events: all part events; stats: (slot, lines_read, parts_found), zeros for slots that gave nothing; errors: (slot,
    error) of slots that could not be read or fetched, and of PDF pages that could not.
    """
    every, more = projects, None
    if fetch:
        projects, found, more = _fetched(projects, reader, timeout)
        pages = found if pages is None else found.unionByName(pages, allowMissingColumns=True)
    routed = dispatch.route(projects)
    lines = ingest.scan_lines(dispatch.text_lines(routed))
    rows = csv.scan_payloads(routed.where("kind = 'csv'").select("slot", "source", "payload"))
    events = _placed(ingest.text_events(lines)).unionByName(_placed(ingest.events_of(rows)))
    stats = ingest.stats(lines).unionByName(ingest.stats(rows)).select("slot", "lines_read", "parts_found")
    errors = routed.where("error IS NOT NULL").select("slot", "error")
    errors = errors if more is None else errors.unionByName(more)
    if pages is not None:
        if "error" in pages.columns:
            errors = errors.unionByName(pages.where("error IS NOT NULL").select("slot", "error").distinct())
            pages = pages.where("error IS NULL").drop("error")
        found = pdf.scan(pages)
        events = events.unionByName(_placed(ingest.events_of(found)))
        stats = stats.unionByName(pdf.stats(pages, found))
    zeros = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("lines_read", "parts_found")]
    none = every.select("slot", F.lit(0).cast("bigint").alias("lines_read"), F.lit(0).cast("bigint").alias("parts_found"))
    stats = stats.unionByName(none).groupBy("slot").agg(*zeros)
    return {"events": events, "stats": stats, "errors": errors}
