"""CSV scans: bills of materials with header synonyms, and stock lists."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty, strip
from ..functions.units import normalize, parse_value
from ..operators.ingest import dealt, resolve
from . import csvfile

REF_HEADERS = ["ref", "designator", "part", "location"]
VALUE_HEADERS = ["value", "val", "description"]


def read(spark, path: str, place: str | None = None) -> DataFrame:
    """Rows as text columns, named by the header of the first file; rows of other files give what theirs has by these
    names. Quoted line breaks and a byte order mark are understood. Rows come in no order: ``place`` names a column for
    (file, record), which has it."""
    found = csvfile.rows(spark, path)
    head = csvfile.parsed(csvfile.records(spark, path)).where("size(cells) > 0").select(F.min_by("cells", F.struct("file", "record"))).first()[0] or []
    heads = [h.removeprefix("\ufeff") for h in head]
    at = lambda h: F.get("cells", F.array_position("heads", F.lit(h)).cast("int") - 1)
    kept = found.where("error IS NULL")
    cols = [F.when(at(h) != "", at(h)).alias(h) for h in dict.fromkeys(heads)]
    return kept.select(*cols, *([F.struct("file", "record").alias(place)] if place else []))


def _first(df: DataFrame, wanted: list[str], by: dict[str, str]):
    found = [nonempty(F.col(f"`{by[w]}`")) for w in wanted if w in by]
    return reduce(lambda a, b: F.coalesce(a, b), found, F.lit(None).cast("string"))


def scan_bom(rows: DataFrame, slot=None, source=None, order=None) -> DataFrame:
    """Rows of one file, resolved; references keep their case. ``order``: a column that orders the rows."""
    by = {c.lower().strip(): c for c in rows.columns if c}
    ref, value = _first(rows, REF_HEADERS, by), _first(rows, VALUE_HEADERS, by)
    if len(rows.columns) == 2:
        a, b = (F.col(f"`{c}`") for c in rows.columns)
        neither = ref.isNull() & value.isNull()
        ref, value = F.when(neither, nonempty(a)).otherwise(ref), F.when(neither, nonempty(b)).otherwise(value)
    both = ref.isNotNull() & value.isNotNull()
    at = F.monotonically_increasing_id() if order is None else order
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    out = rows.select(
        (F.lit(0).cast("bigint") if slot is None else slot).alias("slot"),
        (F.lit("CSV") if source is None else source).alias("source"),
        F.struct(F.lit(0).alias("phase"), at.alias("at")).alias("ordinal"),
        line.alias("line"),
        F.when(both, ref).alias("ref_raw"),
        F.when(both, value).alias("val_raw"),
        F.lit(None).cast("string").alias("pcb"),
    )
    out = resolve(dealt(out))
    return out.withColumn("rejected", (F.col("found") == 0) & (F.coalesce("pos", F.lit(0)) == 0))


def scan_stock(rows: DataFrame) -> DataFrame:
    """(category, value, qty) from columns Category, Part, Qty in any case; rows without an integer quantity go."""
    by = {c.lower(): c for c in rows.columns if c}
    get = lambda name, default="": strip(F.coalesce(F.col(f"`{by[name]}`"), F.lit(default))) if name in by else F.lit(default)
    cat, part, qty = get("category"), get("part"), get("qty", "0")
    whole = F.when(qty.rlike(r"^[+-]?[0-9]+$"), qty.try_cast("bigint"))
    kept = rows.select(cat.alias("category"), part.alias("part"), whole.alias("qty")).where("category <> '' AND part <> '' AND qty IS NOT NULL")
    kept = kept.withColumn("n_", parse_value("part", trimmed=True))
    # never null: else a join on it would test the whole expression for null once more, below the aggregate
    value = F.coalesce(normalize("category", "part", F.col("n_"), trimmed=True), F.lit(""))
    kept = kept.select("category", value.alias("value"), "qty")
    return kept.groupBy("category", "value").agg(F.sum("qty").alias("qty"))


def scan_rows(rows: DataFrame) -> DataFrame:
    """(slot, source, at, heads, cells, line) of any CSV input, each row under its own header, resolved as scan_bom() does."""
    rows = rows.withColumn("heads", F.transform("heads", lambda h: strip(F.lower(h))))
    at = lambda name: nonempty(F.get("cells", F.array_position("heads", F.lit(name)).cast("int") - 1))
    ref, value = F.coalesce(*[at(h) for h in REF_HEADERS]), F.coalesce(*[at(h) for h in VALUE_HEADERS])
    rows = rows.withColumns({"r": ref, "v": value})
    plain = (F.size("heads") == 2) & F.col("r").isNull() & F.col("v").isNull()
    rows = rows.withColumns({"r": F.when(plain, nonempty(F.get("cells", F.lit(0)))).otherwise(F.col("r")), "v": F.when(plain, nonempty(F.get("cells", F.lit(1)))).otherwise(F.col("v"))})
    both = F.col("r").isNotNull() & F.col("v").isNotNull()
    out = rows.select("slot", "source", F.struct(F.lit(0).alias("phase"), F.col("at").cast("bigint").alias("at")).alias("ordinal"), "line", F.when(both, F.col("r")).alias("ref_raw"), F.when(both, F.col("v")).alias("val_raw"), F.lit(None).cast("string").alias("pcb"))
    out = resolve(dealt(out))
    return out.withColumn("rejected", (F.col("found") == 0) & (F.coalesce("pos", F.lit(0)) == 0))


def payload_rows(slots: DataFrame) -> DataFrame:
    """(slot, source, payload) of CSV texts, each with its own header -> (slot, source, at, heads, cells, line, error)."""
    kinds = ", ".join(f"{c} {slots.schema[c].dataType.simpleString()}" for c in ("slot", "source"))

    def run(batches):
        for b in batches:
            out = []
            for i, payload in enumerate(b.column(2).to_pylist()):
                heads = None
                for at, record in enumerate(csvfile.cut((payload or "").removeprefix("\ufeff").split("\n"))):
                    cells, error = csvfile.cells(record)
                    if heads is None and cells:
                        heads = cells
                    elif error or cells:
                        out.append((i, at, heads or [], cells, record.removesuffix("\r"), error))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            take = pa.array(cols[0], pa.int64())
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names=["slot", "source", "at", "heads", "cells", "line", "error"])

    return slots.select("slot", "source", "payload").mapInArrow(run, f"{kinds}, at bigint, heads array<string>, cells array<string>, line string, error string")


def scan_payloads(slots: DataFrame) -> DataFrame:
    """(slot, source, payload) of CSV texts, by the parser that reads files."""
    return scan_rows(payload_rows(slots))


def scan_files(spark, path: str | list[str], slots: DataFrame) -> DataFrame:
    """CSV files -> part candidates, resolved. ``slots`` (file, slot, source) says whose a file is; a file's records
    keep their order, however many tasks read it."""
    found = csvfile.rows(spark, path).join(slots, "file")
    return scan_rows(found.select("slot", "source", F.col("record").alias("at"), "heads", F.coalesce("cells", F.array().cast("array<string>")).alias("cells"), F.coalesce("text", F.lit("")).alias("line")))
