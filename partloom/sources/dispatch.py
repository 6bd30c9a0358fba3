"""Routing of project slots by their input method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty, strip
from .text import lines

TEXT_METHODS = ["Paste Text", "Preset"]


def route(projects: DataFrame) -> DataFrame:
    """(slot, method, payload, path) plus ``kind``: text, pdf, csv, empty, or an ``error``.

    An address gives a PDF if it ends so or its body says so, else its body is read as text; a file goes by its
    extension, and everything that is no PDF is read as CSV.
    """
    path = F.lower(strip(F.coalesce("path", F.lit(""))))
    pdf = path.endswith(".pdf")
    kind = (
        F.when(F.coalesce("payload", F.lit("")) == "", "empty")
        .when(F.col("method").isin(TEXT_METHODS), "text")
        .when(F.col("method") == "From URL", F.when(pdf | F.startswith("payload", F.lit("%PDF")), "pdf").otherwise("text"))
        .when((F.col("method") == "Upload File") & (path != ""), F.when(pdf, "pdf").otherwise("csv"))
    )
    error = F.when(kind.isNotNull(), None).when(F.col("method") == "Upload File", "Invalid file object provided.").otherwise("Unknown Method")
    return projects.withColumns({"kind": F.coalesce(kind, F.lit("none")), "error": error})


def text_lines(routed: DataFrame) -> DataFrame:
    return lines(routed.where("kind = 'text'").select("slot", "source", "payload"))


def source_names(projects: DataFrame, name: str = "name", index: str = "slot_idx") -> DataFrame:
    """Adds ``source``: the slot's name, or a numbered placeholder where it is blank."""
    given = F.coalesce(F.col(name), F.lit(""))
    return projects.withColumn("source", F.when(nonempty(strip(given)).isNotNull(), given).otherwise(F.concat(F.lit("Project #"), (F.col(index) + 1).cast("string"))))


def locked_names(projects: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds ``locked_name``: the slot's name, else its document's title, else the numbered placeholder."""
    named = source_names(projects).join(titles.select("slot", "title"), "slot", "left")
    given = nonempty(strip(F.coalesce("name", F.lit("")))).isNotNull()
    return named.withColumn("locked_name", F.when(given, F.col("name")).otherwise(F.coalesce("title", "source"))).drop("title")
