"""A folder of project files followed as a stream: each run reads what is new in it and nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import library
from ..plans.reports import append_once
from ..sources import pdf

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def crawl(spark, folder: str, log: str, checkpoint: str, reader=pdf.plumbed, files_a_batch: int = 10_000, **trigger) -> StreamingQuery:
    """Texts and PDFs below ``folder`` that are new since the last run, compiled into the crawl's log.

    A file is known by its path and read once: a file stream does not look at what changes in place, so a new version
    comes as a new file, and takes the older one's place where it has its key.

    Without a trigger it reads what there is and ends. Each batch has a folder of its own in the log, so one that runs again
    after a failure adds nothing; ``files_a_batch`` bounds what a batch reads. read() gives the library."""
    found = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,TXT,pdf,PDF}")
    files = found.option("maxFilesPerTrigger", files_a_batch).load(folder)

    def batch(rows: DataFrame, n: int) -> None:
        append_once(library.compiled(rows, folder, reader), log, f"{n:09d}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def log_rows(spark, log: str) -> DataFrame:
    """All that the crawl read, with the ``batch`` of each file."""
    return spark.read.option("basePath", log).schema(f"{library.SCHEMA}, batch string").parquet(log)


def read(spark, log: str) -> DataFrame:
    """The library as of the last run: (full_key, bom_text, source_path, is_pdf)."""
    return library.newest(log_rows(spark, log))
