"""Inventories: aggregation, weighted merge, sources, stock, orders of display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.knowledge import CATEGORIES, Z_HEIGHT, Z_LARGE_CAP, Z_OTHER, Z_SMALL_CAP, Z_SOCKET
from ..functions.refs import in_natural_order
from ..functions.text import col, nonempty
from ..functions.units import bulky, parse_value
from ..storage import discard, save

KEY = ["category", "value"]
CHUNK = 1024  # references of a piece of a source's list
RANGE_BITS = 12  # references are placed over ranges of 4096 slots


SCHEMA = "category string, value string, qty bigint, n_refs bigint, first_slot bigint"


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def aggregate(events: DataFrame) -> DataFrame:
    """(category, value, qty, n_refs, first_slot): one row per part; no lists, so it scales with the parts."""
    return events.groupBy(*KEY).agg(F.sum("qty").alias("qty"), F.count(nonempty(F.col("ref"))).alias("n_refs"), F.min("slot").alias("first_slot"))


def with_refs(events: DataFrame) -> DataFrame:
    """The same with the references in order of sighting; for the events of a few projects."""
    seen = F.array_sort(F.collect_list(F.when(F.col("ref") != "", F.struct("slot", "ordinal", "pos", "kind", "ref"))))
    first = F.min(F.struct("slot", "ordinal", "pos", "kind"))
    return events.groupBy(*KEY).agg(F.sum("qty").alias("qty"), F.transform(seen, lambda x: x["ref"]).alias("refs"), first.alias("first_seen")).withColumn("val_float", parse_value("value"))


def merge(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Quantities times each project's ``count``; references are not multiplied."""
    # a row a project and part is what meets the counts
    each = events.groupBy("slot", *KEY).agg(F.sum("qty").alias("qty"), F.count(nonempty(F.col("ref"))).alias("n_refs"))
    each = each.join(counts.select("slot", "count"), "slot")
    return each.groupBy(*KEY).agg(F.sum(F.col("qty") * F.col("count")).alias("qty"), F.sum("n_refs").alias("n_refs"), F.min("slot").alias("first_slot"))


def sku_count(events: DataFrame) -> DataFrame:
    """One row: how many different parts there are."""
    return events.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("skus"))


def _marked(events: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Events with their project's count; ``board`` tells those of which a project has one mark, however many there are."""
    mark = F.when(F.col("kind") == "pcb", "PCB").otherwise(F.col("ref"))
    rows = events.withColumn("ref", mark).where("ref <> ''").withColumn("board", F.col("kind") == "pcb")
    return rows.join(counts.select("slot", "count"), "slot") if counts is not None else rows.withColumn("count", F.lit(1))


def sources(events: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(category, value, source, refs, n): references by source, repeated by the project's count if given.

    A board's source holds one mark, however often it is listed. What a project has of a part is one row before it is dealt
    by part.
    """
    seen = F.struct("ordinal", "pos", "kind", "ref")
    parts, board = F.collect_list(F.when(~F.col("board"), seen)), F.min(F.when(F.col("board"), seen))
    n = F.count(F.when(~F.col("board"), 1)) + F.max(F.col("board").cast("bigint"))
    each = _marked(events, counts).groupBy("slot", "source", "count", *KEY).agg(F.transform(F.array_sort(F.concat(parts, F.array_compact(F.array(board)))), lambda x: x["ref"]).alias("refs"), n.alias("n"))
    repeated = lambda x: F.flatten(F.transform(x["refs"], lambda r: F.array_repeat(r, x["count"].cast("int"))))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", "refs", "count"))), repeated))
    return each.groupBy(*KEY, "source").agg(listed.alias("refs"), F.sum(F.col("n") * F.col("count")).cast("bigint").alias("n"))


def in_pieces(rows: DataFrame, by: list[str]) -> DataFrame:
    """(slot, *by, piece, refs): the references of each slot and ``by`` in order of sighting, in pieces of CHUNK. Rows that
    are dealt by slot already are not dealt again. Of boards, where rows have the column ``board``, the first counts."""
    order = Window.partitionBy("slot", *by).orderBy("ordinal", "pos", "kind", "ref")
    nth = F.row_number().over(order) - 1
    if "board" in rows.columns:
        boards = F.sum(F.col("board").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumns({"nth": nth, "boards": boards}).where("NOT board OR boards = 1")
        nth = F.col("nth") - F.greatest(F.lit(0), F.col("boards") - 1)  # marks that were left out have no place
    rows = rows.withColumn("nth", nth).withColumn("piece", F.floor(F.col("nth") / CHUNK).cast("int"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", "ref"))), lambda x: x["ref"])
    return rows.groupBy("slot", *by, "piece").agg(listed.alias("refs"))


def source_lists(events: DataFrame, counts: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """(category, value, source, chunk, begins, n, refs): the lists of sources() in pieces of ``size`` references.

    ``refs``: (ref, n) in order of sighting, ``n`` how often the reference stands there in a row; ``begins``: the place
    of its first in the whole list, from 0; ``n``: how many places it takes. No array grows with the input, and
    a count of millions costs no more than one. References are placed within a range of slots, after those of the
    lower ranges, so that a source of very many projects is many tasks; a count of 0 or less has no place.

    What is dealt is one row for what a project has of a part, or several of CHUNK references. Each step is written, so
    that the shuffle files of no two are there at once."""
    # a source may be null, and is equal to itself: so is a struct that holds it, by which rows are dealt once
    rows = in_pieces(_marked(events, counts).where("count > 0"), ["source", "count", *KEY])
    rows = rows.select(F.struct(*KEY, "source").alias("part"), F.shiftright("slot", RANGE_BITS).alias("range"), "slot", "piece", F.col("count").cast("bigint").alias("count"), "refs")
    rows = save(rows, "pieces")
    k = F.size("refs").cast("bigint")
    each = rows.groupBy("part", "range").agg(F.sum(k).alias("k"), F.sum(k * F.col("count")).alias("places"))
    lower = Window.partitionBy("part").orderBy("range")
    before = each.select("part", "range", (F.sum("k").over(lower) - F.col("k")).alias("b_rows"), (F.sum("places").over(lower) - F.col("places")).alias("b_places"))
    before = save(before.where("b_rows > 0"), "before")
    inside = Window.partitionBy("part", "range").orderBy("slot", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"upto": F.sum(k).over(inside), "places": F.sum(k * F.col("count")).over(inside)}).join(before, ["part", "range"], "left")
    place = F.coalesce("b_rows", F.lit(0)) + F.col("upto") - k
    begins = F.coalesce("b_places", F.lit(0)) + F.col("places") - k * F.col("count")
    placed = placed.select("part", "refs", "count", k.alias("k"), place.alias("place"), begins.alias("begins"))
    chunk = lambda at: F.floor(at / size).cast("bigint")
    cut = placed.withColumn("chunk", F.explode(F.sequence(chunk(F.col("place")), chunk(F.col("place") + F.col("k") - 1))))
    cut = cut.withColumn("from", F.greatest(F.lit(0), F.col("chunk") * size - F.col("place")))
    cut = cut.withColumn("k", F.least("k", (F.col("chunk") + 1) * size - F.col("place")) - F.col("from"))
    cut = cut.select("part", "chunk", "count", (F.col("begins") + F.col("from") * F.col("count")).alias("begins"), F.slice("refs", F.col("from").cast("int") + 1, F.col("k").cast("int")).alias("refs"))
    cut = save(cut, "chunks")
    discard(rows, before)
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("begins", "refs", "count"))), lambda x: F.transform(x["refs"], lambda r: F.struct(r.alias("ref"), x["count"].alias("n")))))
    lists = cut.groupBy("part", "chunk").agg(F.min("begins").cast("bigint").alias("begins"), F.sum(k * F.col("count")).cast("bigint").alias("n"), listed.alias("refs"))
    return lists.select("part.*", "chunk", "begins", "n", "refs")


def source_map(by_source: DataFrame) -> DataFrame:
    """One row per part with its map from source to references."""
    return by_source.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("source", "refs"))).alias("sources"))


def rename_source(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows (category, value, source, refs): ``old`` takes the place of ``new``, whose own rows for that part go.

    The parts that ``old`` has are written, so that ``rows`` meet them without being dealt."""
    if old == new:
        return rows
    taken = save(rows.where(F.col("source") == old).select(*KEY).distinct(), "renamed")
    gone = rows.join(taken.withColumn("gone", F.col("category").isNotNull()), KEY, "left")
    kept = gone.where(~(F.col("source").eqNullSafe(new) & F.col("gone").eqNullSafe(True))).select(*rows.columns)
    return kept.withColumn("source", F.when(F.col("source") == old, new).otherwise(F.col("source")))


def net_needs(bom: DataFrame, stock: DataFrame | None) -> DataFrame:
    """Adds ``in_stock`` and ``net``; without stock the net need is the whole."""
    if stock is None:
        return bom.withColumns({"in_stock": F.lit(0).cast("bigint"), "net": F.col("qty")})
    joined = bom.join(stock.select(*KEY, F.col("qty").alias("have")), KEY, "left")
    have = F.coalesce("have", F.lit(0))
    return joined.withColumns({"in_stock": have, "net": F.greatest(F.lit(0).cast("bigint"), F.col("qty") - have)}).drop("have")


def missing_from_stock(bom: DataFrame, stock: DataFrame) -> DataFrame:
    return bom.join(stock, KEY, "left_anti")


def _rank(category: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, r in ranks.items():
        out = out.when(category == name, r)
    return out.otherwise(other)


def category_rank(category: Column | str) -> Column:
    return _rank(col(category), {c: i for i, c in enumerate(CATEGORIES)}, 100)


def display_order() -> list[Column]:
    return [category_rank("category"), F.coalesce(parse_value("value"), F.lit(0.0)), F.col("value")]


def z_rank(category: Column | str, value: Column | str) -> Column:
    """Soldering order: flat parts first."""
    c, v = col(category), col(value)
    return F.when(F.contains(F.upper(v), F.lit("SOCKET")), Z_SOCKET).when(c == "Capacitors", F.when(bulky(v), Z_LARGE_CAP).otherwise(Z_SMALL_CAP)).otherwise(_rank(c, Z_HEIGHT, Z_OTHER))


def marks(rows: DataFrame) -> DataFrame:
    """(project, category, value, ref): a row for each reference; boards have a mark in its place. ``rows``: events under
    their projects' names, or what sources() gives of them."""
    if "refs" in rows.columns:
        return rows.select(F.col("source").alias("project"), *KEY, F.explode("refs").alias("ref"))
    return rows.select(F.col("source").alias("project"), *KEY, F.when(F.col("kind") == "pcb", "PCB").otherwise(F.col("ref")).alias("ref")).where("ref <> ''")


def project_parts(rows: DataFrame) -> DataFrame:
    """(project, category, value, refs, qty): parts of each project with their distinct references in natural order.

    Repeats go before the exchange and after it; there is one."""
    listed = marks(rows).groupBy("project", *KEY).agg(F.collect_set("ref").alias("r"))
    return listed.select("project", *KEY, in_natural_order(F.col("r")).alias("refs"), F.size("r").cast("bigint").alias("qty"))
