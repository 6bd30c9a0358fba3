"""Records of CSV files, one large file in many tasks, with quoted line breaks.

A file is read as lines, split anywhere. Whether a line begins inside of quotes depends on all lines before it, so
every line is read under both assumptions about the beginning of its block (what one task reads of a file at a time):
that it begins a record, and that it continues a quoted field. Lines without quotes, nearly all, keep the state and
cost nothing. What a block does to either state is one row; going over these rows file by file tells each block's true
beginning, and with it each line's record and number. Records of one line, nearly all, stay where they are; the lines
of others meet by their record.

Quotes mean what they do in Python's ``csv`` by default: they open only at the start of a field, double inside, and a
field goes on after a closing quote up to its comma. A field longer than that module's limit is an error, not a value:
so an opening quote that never closes does not gather the rest of a large file in one task.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a field and, times the columns it may have, of a record; the former is that of Python's module.
FIELD, RECORD = 131_072, 1 << 24
TOO_LONG = f"field larger than field limit ({FIELD})"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the text after ``line`` is inside of quotes, if its beginning is (``inside``) or is a record's."""
    at = 0
    while True:
        if not inside and line[at : at + 1] == '"':
            inside, at = True, at + 1
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside = False
        at = line.find(",", at) + 1
        if not at:
            return False


def cut(lines: list[str]) -> list[str]:
    """Lines of one text -> its records, with their line breaks."""
    out, inside = [], False
    for line in lines:
        if inside:
            out[-1] += "\n" + line
        else:
            out.append(line)
        inside = ends_inside(line, inside) if '"' in line else inside
    return out


def cells(record: str) -> tuple[list[str] | None, str | None]:
    """(fields, None), or (None, what is wrong)."""
    try:
        csv.field_size_limit(FIELD)
        return next(csv.reader([record.removesuffix("\r")]), []), None
    except csv.Error as e:
        return None, str(e)


_STATES = "file string, block bigint, at bigint, line string, in0 boolean, in1 boolean, out0 boolean, out1 boolean, n0 bigint, n1 bigint"


def _states(lines: DataFrame) -> DataFrame:
    """Each line under both assumptions (0: its block begins a record, 1: inside of quotes): whether it begins and ends
    inside, and how many records have begun in the block up to it."""

    def run(batches):
        file, block, at, now, begun = None, None, 0, [False, True], [0, 0]
        for b in batches:
            files, blocks, text = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            quoted = pc.match_substring(text, '"').to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, b.num_rows) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if (files[lo], blocks[lo]) != (file, block):
                    file, block, at, now, begun = files[lo], blocks[lo], 0, [False, True], [0, 0]
                marks = np.flatnonzero(quoted[lo:hi])
                found = text.slice(lo, hi - lo).take(pa.array(marks)).to_pylist()
                cols = []
                for k in (0, 1):
                    begins, ends, start = np.empty(hi - lo, bool), np.empty(hi - lo, bool), 0
                    for m, line in zip(marks.tolist(), found, strict=True):
                        begins[start : m + 1] = ends[start:m] = now[k]
                        now[k] = ends[m] = ends_inside(line, now[k])
                        start = m + 1
                    begins[start:] = ends[start:] = now[k]
                    n = begun[k] + np.cumsum(~begins)
                    begun[k] = int(n[-1])
                    cols.append((begins, ends, n))
                (b0, e0, n0), (b1, e1, n1) = cols
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.arange(at, at + hi - lo)), text.slice(lo, hi - lo), *map(pa.array, (b0, b1, e0, e1, n0, n1))], names=[c.split()[0] for c in _STATES.split(", ")])
                at += hi - lo

    return lines.mapInArrow(run, _STATES)


def _blocks(states: DataFrame) -> DataFrame:
    """(file, block, inside, before): how each block begins, and how many records begin before it; a row a block."""
    last = lambda c: F.max_by(c, "at").alias(c)
    each = states.groupBy("file", "block").agg(last("out0"), last("out1"), last("n0"), last("n1"))

    def walk(of):
        of = of.sort_values("block")
        inside, before, out = False, 0, []
        for f, b, *ends in of[["file", "block", "out0", "out1", "n0", "n1"]].itertuples(index=False):
            out.append((f, b, inside, before))
            inside, before = bool(ends[inside]), before + int(ends[2 + inside])
        return type(of)(out, columns=["file", "block", "inside", "before"])

    return each.groupBy("file").applyInPandas(walk, "file string, block bigint, inside boolean, before bigint")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, text, error): all records with their numbers in the file, from 1, blank ones too."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    states = _states(lines)
    of = _blocks(states).withColumnsRenamed({"file": "f_", "block": "b_"})
    at = states.join(of, (F.col("file") == F.col("f_")) & (F.col("block") == F.col("b_")))
    pick = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    at = at.select("file", "block", "at", "line", (F.col("before") + pick("n")).alias("record"), (~pick("in") & ~pick("out")).alias("whole"))
    none = F.lit(None).cast("string")
    whole = at.where("whole").select("file", "record", F.col("line").alias("text"), none.alias("error"))
    rest = at.where("NOT whole")
    long = rest.groupBy("file", "record").agg(F.sum(F.length("line") + 1).alias("chars")).where(F.col("chars") > RECORD).select("file", "record")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    met = rest.join(long, ["file", "record"], "left_anti").groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))
    return whole.unionAll(met.select("file", "record", "text", none.alias("error"))).unionAll(long.select("file", "record", none.alias("text"), F.lit(TOO_LONG).alias("error")))


def parsed(found: DataFrame) -> DataFrame:
    """records() with ``cells``, an array of fields, and what is wrong with those that have none."""
    keep = [c for c in found.columns if c not in ("text", "error")]
    fields = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            text, error = b.column("text").to_pylist(), b.column("error").to_pylist()
            got = [(None, e) if t is None else cells(t) for t, e in zip(text, error, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("text"), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string())], names=[*keep, "text", "cells", "error"])

    return found.select(*keep, "text", "error").mapInArrow(run, f"{fields}, text string, cells array<string>, error string")


def rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record, text, heads, cells, error) of all records after each file's first that is not blank; that gives
    ``heads``. Blank records go; a byte order mark is no part of the header."""
    found = parsed(records(spark, path)).where("error IS NOT NULL OR size(cells) > 0")
    first = found.groupBy("file").agg(F.min("record").alias("head"), F.min_by("cells", "record").alias("heads"))
    mark = F.transform("heads", lambda c, i: F.when(i == 0, F.regexp_replace(c, "^﻿", "")).otherwise(c))
    first = first.select(F.col("file").alias("f_"), "head", mark.alias("heads"))
    joined = found.join(first, F.col("file") == F.col("f_")).where("record > head")
    return joined.select("file", "record", "text", F.coalesce("heads", F.array().cast("array<string>")).alias("heads"), "cells", "error")
