"""What queries write to disk besides their result: exchanges over references, and shuffle files of tables already written."""

import os
import re

import __spark_entry__
import pytest
from partloom import storage
from partloom.operators import ingest, inventory
from partloom.plans.queries import Data
from pyspark.sql import functions as F


def exchanges(df) -> list[str]:
    """The plan's exchanges, without broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)Exchange \S+", plan)


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getPath() for i in range(files.size())) if os.path.basename(f).startswith("shuffle_")}


def test_events_are_dealt_once(spark, sf):
    assert len(exchanges(Data(spark, sf).events)) == 1


def test_origin_filter_deals_lines_once(spark, sf):
    # lines, counts of projects, the bill, the bill with its hardware, stock, the number of projects
    assert len([e for e in exchanges(__spark_entry__.queries()["origin_filter"](spark, sf))]) <= 6


def test_shuffles_of_a_table_go_when_it_is_written(spark):
    before = shuffle_files(spark)
    rows = storage.save(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert shuffle_files(spark) <= before
    assert rows.count() == 7
    assert spark.conf.get(storage.CLEANUP, "false") == "false"


@pytest.mark.parametrize("line, pcb, rejected", [("BIG PCB v1", "BIG PCB v1", False), ("PCB Fuzz", "Fuzz", False), ("PCB", None, False), ("BIG v1", None, True), ("R1 10kpcb", None, False)])
def test_fallback_of_lines(spark, line, pcb, rejected):
    rows = spark.createDataFrame([(1, "s", (1,), line)], "slot bigint, source string, ordinal struct<at1:int>, line string")
    got = ingest.scan_lines(rows).select("pcb", "rejected", "line").collect()
    assert [tuple(r) for r in got] == [(pcb, rejected, line)]


def test_sources_deal_parts_of_projects(spark, sf):
    d = Data(spark, sf)
    # lines, projects' names, projects' counts, the rows by part
    assert len(exchanges(inventory.sources(d.named, d.projects).select(*inventory.KEY, "source", "n"))) <= 4


def test_rename_deals_no_rows_again(spark, sf):
    assert len(exchanges(__spark_entry__.queries()["rename_source"](spark, sf))) <= 3


def test_rename_keeps_rows_without_a_source(spark):
    rows = spark.createDataFrame([("R", "1", None, 1), ("R", "1", "a", 2), ("R", "1", "b", 3), ("R", "2", "b", 4), (None, "1", "b", 5)], "category string, value string, source string, n int")
    got = {tuple(r) for r in inventory.rename_source(rows, "a", "b").collect()}
    assert got == {("R", "1", None, 1), ("R", "1", "b", 2), ("R", "2", "b", 4), (None, "1", "b", 5)}


def test_boards_once_among_parts_of_their_name(spark):
    rows = [(0, "s", 3, "pcb", ""), (0, "s", 1, "pcb", ""), (0, "s", 2, "part", "R1"), (0, "s", 4, "part", "R2"), (1, "s", 1, "pcb", ""), (2, None, 1, "pcb", "")]
    events = spark.createDataFrame(rows, "slot bigint, source string, at int, kind string, ref string").selectExpr("slot", "source", "struct(at) AS ordinal", "0 AS pos", "'PCB' AS category", "'x' AS value", "ref", "1L AS qty", "kind")
    counts = spark.createDataFrame([(0, 2), (1, 1), (2, 3)], "slot bigint, count int")
    got = {r.source: (r.refs, r.n) for r in inventory.sources(events, counts).collect()}
    assert got == {"s": (["PCB", "PCB", "R1", "R1", "R2", "R2", "PCB"], 7), None: (["PCB"] * 3, 3)}
    lists = {(r.source, r.chunk): (r.begins, r.n, [tuple(x) for x in r.refs]) for r in inventory.source_lists(events, counts, size=3).collect()}
    assert lists == {("s", 0): (0, 6, [("PCB", 2), ("R1", 2), ("R2", 2)]), ("s", 1): (6, 1, [("PCB", 1)]), (None, 0): (0, 3, [("PCB", 3)])}


@pytest.mark.parametrize("name, most", [("serialize_inventory", 3), ("inventory_source_lists", 1), ("condense_refs", 1), ("sticker_grid", 1), ("field_manual", 3), ("pdf_regex_scan", 6), ("archive_sheets", 1)])
def test_exchanges_of_the_last_step(spark, sf, name, most):
    """What is read to give the result: steps before it are written, and their shuffle files are gone."""
    assert len(exchanges(__spark_entry__.queries()[name](spark, sf))) <= most


def test_slots_are_one_row_a_part(spark, sf):
    events = Data(spark, sf).events.where("kind <> 'pcb'")
    pieces = inventory.in_pieces(events, inventory.KEY)
    assert len(exchanges(pieces)) == 1
    assert pieces.count() == events.select("slot", *inventory.KEY).distinct().count()
    assert pieces.agg(F.sum(F.size("refs"))).first()[0] == events.count()


def test_references_of_one_number_are_two(spark):
    from partloom.operators.condensing import condensed

    rows = spark.createDataFrame([("p", r) for r in ("R1", "R01", "R2", "R2", "X", None)], "project string, ref string")
    got = condensed(rows, ["project"], dealt=["project"])
    assert len(exchanges(got)) == 1
    assert [tuple(r) for r in got.collect()] == [("p", "X, R1, R1-R2", 4)]
