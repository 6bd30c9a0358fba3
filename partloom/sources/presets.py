"""Preset library: built from a folder of project files, and its metadata.

A library is a parameter: a folder ``source/category/file.txt`` as build() reads it, or any table
(full_key, bom_text, source_path, is_pdf).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import PRESET_KEY
from ..functions.text import nonempty

SCHEMA = "full_key string, bom_text string, source_path string, is_pdf boolean"


def title_case(c):
    """Upper case after every non-letter, lower case elsewhere."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\P{L}+|\p{L}+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def capital(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def placed(path: str, folder: str) -> list[Column]:
    """(source_path, source, category, name) that a file's place below ``folder`` gives it: the first folder is the source,
    the second the category, as it stands before a name in a key."""
    parts = F.split(F.regexp_replace(path, r"^file:/+", "/"), "/")
    depth = len([p for p in re.sub("^file:/+", "/", folder).rstrip("/").split("/") if p])
    rel = F.slice(parts, depth + 2, F.greatest(F.size(parts) - depth - 1, F.lit(0)))
    top = F.when(F.size(rel) > 1, F.get(rel, F.lit(0))).otherwise("Misc")
    source = F.when(F.lower(top) == "pedalpcb", "PedalPCB").otherwise(capital(top))
    category = F.when(F.size(rel) > 2, F.concat(F.lit("["), capital(F.get(rel, F.lit(1))), F.lit("] "))).otherwise("")
    name = title_case(F.regexp_replace(F.regexp_replace(F.element_at(rel, -1), r"\.[^.]*$", ""), "[_-]", " "))
    return [F.array_join(parts, "/").alias("source_path"), source.alias("source"), category.alias("category"), name.alias("name")]


def key(name: str) -> Column:
    """The key of a file that placed() describes, under ``name``."""
    return F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("category"), F.col(name))


def build(spark, folder: str) -> DataFrame:
    """Text files below ``folder``, as they are; empty files and other kinds are ignored. plans.library reads PDFs too, and
    streaming.crawl follows a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,TXT}").load(folder)
    rows = files.select(F.decode("content", "UTF-8").alias("bom_text"), *placed("path", folder))
    return rows.select(key("name").alias("full_key"), "bom_text", "source_path", F.lit(False).alias("is_pdf")).orderBy("full_key")


def metadata(presets: DataFrame, key: str = "full_key") -> DataFrame:
    """(full_key, source, category, name); keys that are not of the form are left out."""
    part = lambda i: F.regexp_extract(key, PRESET_KEY, i)
    return presets.where(F.col(key).rlike(PRESET_KEY)).select(F.col(key).alias("full_key"), part(1).alias("source"), F.coalesce(nonempty(part(2)), F.lit("Misc")).alias("category"), part(3).alias("name"))


def categories(meta: DataFrame) -> DataFrame:
    return meta.groupBy("source").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def labels(meta: DataFrame, source: str = "All", category: str = "All") -> DataFrame:
    """Filtered keys with the label a chooser shows."""
    kept = meta
    if source != "All":
        kept = kept.where(F.col("source") == source)
    if category != "All":
        kept = kept.where(F.col("category") == category)
    extra = F.concat_ws(", ", F.col("source") if source == "All" else F.lit(None), F.when(F.col("category") != "Misc", F.col("category")) if category == "All" else F.lit(None))
    return kept.select("full_key", F.when(extra == "", F.col("name")).otherwise(F.concat("name", F.lit("  ("), extra, F.lit(")"))).alias("label"))


def lookup(slots: DataFrame, library: DataFrame) -> DataFrame:
    """``slots`` (slot, key) with the ``payload`` that the library (full_key, bom_text) has under the key; unknown keys
    and no key give an empty one."""
    found = library.select(F.col("full_key").alias("key"), F.col("bom_text").alias("payload"))
    return slots.join(found, "key", "left").select(*slots.columns, F.coalesce("payload", F.lit("")).alias("payload"))


def first(meta: DataFrame) -> DataFrame:
    """The key that a new slot shows."""
    return meta.select(F.min("full_key").alias("full_key"))
