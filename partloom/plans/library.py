"""Preset libraries: folders of project files, texts and PDFs, as keys with a part list each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty, strip
from ..operators import ingest
from ..operators.inventory import KEY, display_order
from ..operators.ordering import numbered
from ..sources import pdf, presets
from ..storage import save

#: A file of a crawl: its key and list, or null and the reason.
SCHEMA = "source_path string, full_key string, bom_text string, is_pdf boolean, error string"


def listed(events: DataFrame, by: str = "slot") -> DataFrame:
    """(by, bom_text): what each ``by`` has, a line a reference, in order of display; hardware marks are left out. Parts
    without any reference are a line with their quantity."""
    order = [*display_order(), F.col("category")]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "ordinal", "pos", "kind", "ref").alias("place")
    named = events.where("ref <> '' AND ref <> 'HW'").select(by, place, F.concat("ref", F.lit(" "), "value").alias("line"))
    bare = events.groupBy(by, *KEY).agg(F.sum("qty").alias("qty"), F.count(nonempty(F.col("ref"))).alias("n"), F.min("ordinal").alias("ordinal"), F.min("pos").alias("pos"), F.min("kind").alias("kind"), F.min("ref").alias("ref"))
    bare = bare.where("n = 0").select(by, place, F.concat("value", F.lit(" (Qty: "), F.col("qty").cast("string"), F.lit(")")).alias("line"))
    return named.unionByName(bare).groupBy(by).agg(F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY place)").alias("bom_text"))


def compiled(files: DataFrame, folder: str, reader=pdf.plumbed) -> DataFrame:
    """Files (path, content) below ``folder`` -> a row each, as SCHEMA says.

    A text is its own list. A PDF is read by ``reader`` (see pdf.extract) and its parts are listed; its title, where it has
    one, takes the place of the file's name, and a PedalPCB project gets its board as a part. Null ``full_key``: empty files,
    texts that are not UTF-8, PDFs without parts or that cannot be read at all; of those with some failing pages the others
    count, and ``error`` tells the first failure. Other kinds of files give no row; a null content is an empty file."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"), kind.alias("kind")).where("kind IN ('txt', 'pdf')")
    files = numbered(files, "path", name="slot").select("slot", "content", F.col("kind").eqNullSafe("pdf").alias("is_pdf"), *presets.placed("path", folder))

    texts = files.where("NOT is_pdf").withColumn("valid", F.try_validate_utf8(F.col("content").cast("string")))
    lines = strip(F.regexp_replace("valid", "\r\n?", "\n"))
    why = F.when(F.col("valid").isNull(), "File Error: not UTF-8").when(F.col("valid") == "", "Empty file.")
    texts = texts.withColumn("error", why).select("source_path", F.when(F.col("error").isNull(), presets.key("name")).alias("full_key"), F.when(F.col("error").isNull(), lines).alias("bom_text"), "is_pdf", "error")

    docs = files.where("is_pdf")
    pages = save(pdf.extract(docs.select("slot", F.col("name").alias("source"), "content"), reader), "pages")
    failed = pages.where("error IS NOT NULL").groupBy("slot").agg(F.min_by("error", "page").alias("failure"))
    good = pages.where("error IS NULL").drop("error")
    titled = docs.drop("content").join(pdf.titles(good), "slot", "left").withColumn("name", F.coalesce(nonempty(strip("title")), "name"))
    # written, as the boards and both kinds of lines look at them: one plan with the scan in it many times is too large
    events = save(ingest.events_of(pdf.scan(good)), "events")
    some = events.select("slot").distinct().join(titled, "slot").where("source = 'PedalPCB'")
    last = F.struct(F.lit(2).alias("phase"), *[F.lit(0).cast("bigint").alias(f"k{i}") for i in range(3)])
    boards = some.select("slot", "source", last.alias("ordinal"), F.lit(0).alias("pos"), F.lit("PCB").alias("category"), F.concat("name", F.lit(" PCB")).alias("value"), F.lit("PCB").alias("ref"), F.lit(1).cast("bigint").alias("qty"), F.lit("pcb").alias("kind"))
    found = titled.join(listed(events.unionByName(boards)), "slot", "left").join(failed, "slot", "left")
    found = found.select("source_path", F.when(F.col("bom_text").isNotNull(), presets.key("name")).alias("full_key"), "bom_text", "is_pdf", F.coalesce("failure", F.when(F.col("bom_text").isNull(), "No parts found.")).alias("error"))
    return texts.unionByName(found)


def newest(crawled: DataFrame) -> DataFrame:
    """Rows of SCHEMA with the ``batch`` each came in -> the library (full_key, bom_text, source_path, is_pdf): a path
    that was read again counts as it was last; of paths with one key the newest batch's stays, in a batch the last path."""
    last = crawled.groupBy("source_path").agg(F.max_by(F.struct("full_key", "bom_text", "is_pdf", "batch"), "batch").alias("f")).select("source_path", "f.*")
    one = F.max_by(F.struct("bom_text", "source_path", "is_pdf"), F.struct("batch", "source_path")).alias("p")
    return last.where("full_key IS NOT NULL").groupBy("full_key").agg(one).select("full_key", "p.*")
