"""The master shopping list and what is written from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.knowledge import GERMANIUM, NOTES, POT_HARDWARE
from ..functions.search import bare_pot, pedalpcb_url, search_term, tayda_url
from ..functions.units import parse_value, spec_type
from ..operators.inventory import KEY, display_order, net_needs
from ..operators.purchasing import AUTO, buy_note, buy_quantity, kit

EXTRA = "SOCKET|ADAPTER"


def bill(events: DataFrame, projects: DataFrame) -> DataFrame:
    """(category, value, qty, pedalpcb, tayda): quantities times counts, and whose boards the sources name."""
    named = projects.select("slot", "count", F.contains("source", F.lit("PedalPCB")).alias("pedalpcb"), F.contains("source", F.lit("Tayda")).alias("tayda"))
    # counts per project and part shrink the rows before the join and again before the exchange
    each = events.groupBy("slot", *KEY).agg(F.sum("qty").alias("qty"))
    return each.join(named, "slot").groupBy(*KEY).agg(F.sum(F.col("qty") * F.col("count")).alias("qty"), F.max("pedalpcb").alias("pedalpcb"), F.max("tayda").alias("tayda"))


def with_hardware(bom: DataFrame, projects: DataFrame) -> DataFrame:
    """The bill with the hardware kit merged in: ``parsed`` tells parts of the bill, ``auto`` holds the kit's note.

    What depends on the bill comes from its own rows in the same pass: each potentiometer brings its knob and seal,
    each fuzz board the vintage transistor. Their sums are the totals that hardware() gives."""
    names = "struct<category:string,value:string,qty:bigint,pedalpcb:boolean,tayda:boolean,parsed:boolean,auto:string,autos:bigint>"
    row = lambda c, v, q, p, t, parsed, auto, n: F.struct(*[x if not isinstance(x, (str, bool, type(None))) else F.lit(x) for x in (c, v, q, p, t, parsed, auto, n)]).cast(names)
    q, zero = F.col("qty"), F.lit(0).cast("bigint")
    own = row(F.col("category"), F.col("value"), q, F.col("pedalpcb"), F.col("tayda"), True, None, zero)
    pot = F.col("category").startswith("Potentiometers")
    fuzz = F.col("category").startswith("PCB") & F.contains(F.upper(F.concat_ws(" | ", *KEY)), F.lit("FUZZ"))
    more = [F.when(pot, row("Hardware/Misc", name, q, False, False, False, label, q)) for name, label in POT_HARDWARE]
    more.append(F.when(fuzz, row(GERMANIUM[0], GERMANIUM[1], zero, False, False, False, GERMANIUM[2], zero)))
    a = bom.select(F.explode(F.array_compact(F.array(own, *more))).alias("e")).select("e.*")
    b = kit(bom.sparkSession, projects).select(*KEY, "qty", F.lit(False).alias("pedalpcb"), F.lit(False).alias("tayda"), F.lit(False).alias("parsed"), F.col("note").alias("auto"), zero.alias("autos"))
    merged = a.unionByName(b).groupBy(*KEY).agg(F.sum("qty").alias("qty"), *[F.max(c).alias(c) for c in ("pedalpcb", "tayda", "parsed", "auto")], F.sum("autos").alias("autos"))
    counted = F.when(F.col("autos") > 0, F.concat(F.lit(" ("), F.col("autos").cast("string"), F.lit(")"))).otherwise("")
    return merged.withColumn("auto", F.concat(F.lit(f"{AUTO} ("), "auto", counted, F.lit(")"))).drop("autos")


def shopping_list(events: DataFrame, projects: DataFrame, stock: DataFrame | None = None, show_hardware: bool = True, show_extras: bool = True) -> DataFrame:
    """Rows of the list in plain names, unsorted: origin, category, part, bom_qty, in_stock, net_need, buy_qty, notes,
    search_term, link."""
    full = net_needs(with_hardware(bill(events, projects), projects), stock)
    pure, extra = ~F.col("parsed"), F.col("value").rlike(EXTRA)
    if not show_hardware:
        full = full.where(~pure)
    if not show_extras:
        full = full.where(~extra)
    origin = F.when(pure, "Hardware Kit").when(extra, "Extras").otherwise("Circuit Board")
    full = full.withColumns({"origin": origin, "number": parse_value("value", trimmed=True), "bare": bare_pot("value")})
    full = full.withColumns({"spec": spec_type("category", "value", F.col("number")), "pot": parse_value("bare", trimmed=True)})
    number = F.col("number")
    full = full.withColumns({"buy_qty": buy_quantity("category", "value", "net", number), "term": search_term("category", "value", "spec", F.col("bare"), F.col("pot"))})
    note = buy_note("category", "value", "net", number)
    note = F.when(F.col("auto").isNotNull() & (F.col("origin") != "Hardware Kit"), F.concat(note, F.lit(" | " + NOTES["standard"]), F.col("auto"))).otherwise(note)
    link = F.when((F.col("category") == "PCB") & F.col("pedalpcb") & ~F.col("tayda"), pedalpcb_url("term")).otherwise(tayda_url("term"))
    return full.select("origin", "category", F.col("value").alias("part"), F.col("qty").alias("bom_qty"), "in_stock", F.col("net").alias("net_need"), "buy_qty", note.alias("notes"), F.col("term").alias("search_term"), link.alias("link"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("part", "value").orderBy(*display_order()).withColumnRenamed("value", "part")


def stock_update(rows: DataFrame) -> DataFrame:
    """Stock after buying and building; what runs out is left out."""
    left = F.col("in_stock") + F.col("buy_qty") - F.col("bom_qty")
    return rows.select("category", "part", left.alias("qty")).where("qty > 0")


def csv_columns(rows: DataFrame, with_stock: bool = True, excel: bool = False) -> DataFrame:
    """The list's columns under their headings; links as spreadsheet formulas if ``excel``."""
    link = F.when(F.col("link") != "", F.concat(F.lit('=HYPERLINK("'), "link", F.lit('", "Buy")'))).otherwise(F.col("link")) if excel else F.col("link")
    heads = {"Category": "category", "Part": "part", "BOM Qty": "bom_qty", "In Stock": "in_stock", "Net Need": "net_need", "Buy Qty": "buy_qty", "Notes": "notes", "Search Term": "search_term", "Tayda_Link": None, "Origin": "origin"}
    if not with_stock:
        heads = {k: v for k, v in heads.items() if k not in ("In Stock", "Net Need")}
    return rows.select(*[(link if v is None else F.col(v)).alias(k) for k, v in heads.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header, in order; the list has a row a part."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def csv_text(columns: list[str], rows) -> bytes:
    """Rows as a spreadsheet: byte order mark, CRLF."""
    import csv
    import io

    buf = io.StringIO()
    out = csv.writer(buf)
    out.writerow(columns)
    for r in rows:
        out.writerow(["" if x is None else x for x in r])
    return buf.getvalue().encode("utf-8-sig")


def csv_bytes(rows: DataFrame) -> bytes:
    """A list as one spreadsheet download. Rows are streamed to the driver one by one."""
    return csv_text(rows.columns, rows.toLocalIterator())
