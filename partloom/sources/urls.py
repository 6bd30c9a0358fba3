"""Slots whose input is an address: fetched by tasks, never by the driver, each with its own outcome."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Seconds that an answer may take.
TIMEOUT = 10.0
_SCHEMA = "slot bigint, source string, url string, text string, content binary, error string"


def get(url: str, timeout: float = TIMEOUT, tries: int = 1) -> tuple[str | None, bytes | None]:
    """(text, None), or (None, content) of a PDF, which its address or its first bytes tell. Raises what goes wrong;
    what may pass by itself (no answer, or one of a server's own failure) is tried ``tries`` times."""
    from urllib.error import HTTPError, URLError
    from urllib.request import urlopen

    for left in range(tries - 1, -1, -1):
        try:
            with urlopen(url, timeout=timeout) as answer:
                body = answer.read()
                charset = answer.headers.get_content_charset() or "utf-8"
            break
        except HTTPError as e:
            if not left or e.code < 500:
                raise
        except (URLError, OSError):
            if not left:
                raise
    if url.lower().endswith(".pdf") or body.startswith(b"%PDF"):
        return None, body
    try:
        return body.decode(charset, "replace"), None
    except LookupError:
        return body.decode("utf-8", "replace"), None


def fetched(slots: DataFrame, timeout: float = TIMEOUT, tries: int = 2, tasks: int = 64) -> DataFrame:
    """(slot, source, url) -> with ``text``, or ``content`` of a PDF, or an ``error``. At most ``tasks`` fetch at a time.

    Answers may differ from one fetch to the next: write the result before it is read twice."""
    dealt = slots.select(F.col("slot").cast("bigint").alias("slot"), F.col("source"), strip("url").alias("url")).repartition(tasks, "slot")

    def run(batches):
        for b in batches:
            out = []
            for url in b.column(2).to_pylist():
                try:
                    out.append((*get(url, timeout, tries), None))
                except Exception as e:  # an address's failure is its slot's result, whatever it is
                    out.append((None, None, str(e) or type(e).__name__))
            text, content, error = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string()), pa.array(content, pa.binary()), pa.array(error, pa.string())], names=["slot", "source", "url", "text", "content", "error"])

    return dealt.mapInArrow(run, _SCHEMA)
