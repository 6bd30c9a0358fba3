import csv as python_csv
import io
import random

import pytest
from pyspark.sql import functions as F

from partloom.operators import ingest
from partloom.sources import csv, csvfile


def written(seed, n):
    """A file with quoted line breaks, doubled quotes, quotes inside of plain fields and after closing ones."""
    rng = random.Random(seed)
    field = lambda: rng.choice(["", "x", "R1", "10k", '"a,b"', '"a\nb"', '"say ""hi"""', '5" pot', 'a"b"c', '"x"y', '""', '"\n\n,"', " sp ", "é", '"one\r\ntwo"', '"tail" "', "'q'"])
    return "﻿Ref,Value,Note\n" + "".join(",".join(field() for _ in range(rng.randint(1, 4))) + rng.choice(["\n", "\r\n"]) + rng.choice(["", "", "\n"]) for _ in range(n))


def python_rows(text):
    rows = [r for r in python_csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
    return rows[0], rows[1:]


@pytest.mark.parametrize("seed", range(2))
def test_files_cut_anywhere_equal_pythons_module(spark, tmp_path, seed):
    text = written(seed, 500)
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_bytes(written(seed + 9, 40).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(700 + 13 * seed))
    try:
        found = csvfile.rows(spark, str(tmp_path / "*.csv"))
        assert csvfile.records(spark, str(tmp_path)).select("file").distinct().count() == 2
        assert spark.read.text(str(tmp_path / "a.csv"), lineSep="\n").rdd.getNumPartitions() > 8
        got = found.where(F.col("file").endswith("a.csv")).orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    heads, rows = python_rows(text)
    assert [list(r.cells) for r in got] == rows and all(list(r.heads) == heads for r in got)


def test_state_of_lines():
    for line, outside, inside in [("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('x",y', False, False), ('"a""', True, False), ('",', True, False), ('","', False, True), ("", False, True), ('"a"b"c', False, False)]:
        assert (csvfile.ends_inside(line, False), csvfile.ends_inside(line, True)) == (outside, inside), line


def test_quote_that_never_closes(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("Ref,Value\nR1,1k\n" + 'C1,"open\n' + "filler line\n" * 30_000)
    found = csvfile.rows(spark, str(tmp_path / "a.csv")).orderBy("record").collect()
    assert [(r.record, r.error) for r in found] == [(2, None), (3, csvfile.TOO_LONG)]


def test_one_header_a_file_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Designator,Value\nR1,10k\nR1,22k\nC1,"100n\nfilm"\n,x\n')
    (tmp_path / "b.csv").write_text("what,ever\nQ1,2N3904\n")
    (tmp_path / "c.csv").write_text("")
    files = csvfile.records(spark, str(tmp_path)).select("file").distinct()
    slots = files.select("file", F.when(F.col("file").endswith("a.csv"), 1).otherwise(2).cast("long").alias("slot"), F.lit("CSV").alias("source"))
    found = csv.scan_files(spark, str(tmp_path), slots)
    assert sorted((r.slot, r.ref, r.value) for r in found.where("valid").collect()) == [(1, "C1", "100n"), (1, "R1", "10k"), (2, "Q1", "2N3904")]
    stats = {r.slot: (r.lines_read, r.parts_found, r.residuals) for r in ingest.stats(found).collect()}
    assert stats == {1: (4, 2, 2), 2: (1, 1, 0)}


def test_payloads_with_quoted_line_breaks(spark):
    text = written(3, 60)
    heads, rows = python_rows(text)
    df = spark.createDataFrame([(1, "A", text), (2, "B", None), (3, "C", "Ref\n")], "slot long, source string, payload string")
    got = csv.payload_rows(df).orderBy("at").collect()
    assert [list(r.cells) for r in got] == rows and {r.slot for r in got} == {1} and list(got[0].heads) == heads
