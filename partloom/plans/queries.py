"""One query for each operator, over the benchmark's tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import refs as R
from ..functions import units as U
from ..functions.search import bare_pot, pedalpcb_url, search_term, tayda_url
from ..operators import ingest, inventory, purchasing
from ..operators.classify import with_class
from ..operators.condensing import condensed
from ..operators.ordering import numbered
from ..sources import csv, dispatch, pdf, presets, text
from . import adapters, archive, intake, library, reports, shopping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Data(spark, sf_dir))

    QUERIES[f.__name__] = run
    return run


class Data:
    """The adapters' tables, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    @cached_property
    def lines(self) -> DataFrame:
        return adapters.lines(self.spark, self.sf_dir)

    @cached_property
    def scanned(self) -> DataFrame:
        return ingest.scan_lines(self.lines)

    @cached_property
    def events(self) -> DataFrame:
        return ingest.text_events(self.scanned)

    @property
    def projects(self) -> DataFrame:
        return adapters.projects(self.spark, self.sf_dir)

    @property
    def stock(self) -> DataFrame:
        return csv.scan_stock(adapters.stock(self.spark, self.sf_dir))

    @property
    def bill(self) -> DataFrame:
        return shopping.bill(self.events, self.projects)

    @property
    def shopping(self) -> DataFrame:
        return shopping.shopping_list(self.events, self.projects, self.stock)

    @property
    def named(self) -> DataFrame:
        """Events under their projects' names."""
        return self.events.drop("source").join(self.projects.select("slot", "source"), "slot")

    @property
    def by_source(self) -> DataFrame:
        return inventory.sources(self.named)

    @property
    def values(self) -> DataFrame:
        v = self.spark.sql(adapters.VALUES, lineitem=self.table("lineitem"))
        return v.withColumn("number", U.parse_value("value"))

    @property
    def keys(self) -> DataFrame:
        return self.spark.sql(adapters.PRESET_KEYS, orders=self.table("orders"))


@query
def shopping_list(d):
    return d.shopping


@query
def text_scan_stats(d):
    return ingest.stats(d.scanned)


@query
def document_scan(d):
    payloads = d.table("documents").select(F.col("doc_id").alias("slot"), F.lit("doc").alias("source"), F.col("text").alias("payload"))
    return text.lines(payloads).groupBy("slot").agg(F.count(F.lit(1)).alias("lines_read"), F.sum(F.col("line").rlike(ingest.TOKEN).cast("bigint")).alias("tokens"))


@query
def residual_report(d):
    return ingest.suspicious(ingest.residuals(d.scanned)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def pcb_lines(d):
    return d.scanned.where("pcb IS NOT NULL").groupBy(F.col("pcb").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query
def si_parse(d):
    return d.values


@query
def si_search_string(d):
    return d.values.select("value", U.search_string("number").alias("search"))


@query
def si_display_string(d):
    return d.values.select("value", U.display_string("number").alias("display"))


@query
def normalize_value(d):
    each = d.values.withColumn("category", F.explode(F.array(*[F.lit(c) for c in ("Resistors", "Capacitors", "Diodes")])))
    return each.select("category", "value", U.normalize("category", "value", F.col("number")).alias("normal"))


@query
def spec_type(d):
    return d.values.select("value", U.spec_type(F.lit("Capacitors"), "value", F.col("number")).alias("spec"))


@query
def expand_refs(d):
    return d.scanned.where("ref IS NOT NULL").select("ref_raw", "pos", "ref").distinct()


@query
def first_wins_dedupe(d):
    return d.scanned.where("fresh").select("slot", "ref", "val_raw")


@query
def classify_parts(d):
    pairs = d.scanned.where("fresh").select("ref", "val_raw").distinct()
    return with_class(pairs).select("ref", "val_raw", "category", "value")


@query
def socket_injection(d):
    return d.events.where("kind = 'socket'").select("slot", "ref")


@query
def inventory_agg(d):
    return inventory.aggregate(d.events)


@query
def inventory_merge_weighted(d):
    return inventory.merge(d.events, d.projects)


@query
def inventory_sources(d):
    return d.by_source.select("category", "value", "source", "n")


@query
def inventory_sources_weighted(d):
    return inventory.sources(d.named, d.projects).select("category", "value", "source", "n")


@query
def inventory_source_lists(d):
    lists = inventory.source_lists(d.named, d.projects)
    return lists.withColumn("refs", F.array_join(F.transform("refs", lambda x: F.concat(x["ref"], F.lit("*"), x["n"].cast("string"))), " "))


@query
def sku_count(d):
    return inventory.sku_count(d.events)


@query
def preset_lookup(d):
    """Each project asks for a key; a third of them for one that the library lacks."""
    library = d.keys.select(F.col("key").alias("full_key"), F.concat(F.lit("R1 10k # "), "key").alias("bom_text"))
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.lit("[None] such")).otherwise(F.concat(F.lit("[Tayda] Box "), (F.col("o_custkey") % 80).cast("string")))
    return presets.lookup(d.table("orders").select(F.col("o_orderkey").alias("slot"), asked.alias("key")), library)


@query
def rename_source(d):
    return inventory.rename_source(d.by_source.select("category", "value", "source", "n"), "PedalPCB 1", "PedalPCB 2")


@query
def stock_parse(d):
    return d.stock


@query
def net_needs(d):
    return inventory.net_needs(d.bill.select("category", "value", "qty"), d.stock)


@query
def missing_from_stock(d):
    return inventory.missing_from_stock(d.bill.select("category", "value", "qty"), d.stock.select("category", "value"))


@query
def buy_details(d):
    rows = inventory.aggregate(d.events).select("category", "value", (F.col("qty") - 40).alias("need")).withColumn("number", U.parse_value("value", trimmed=True))
    number = F.col("number")
    return rows.select("category", "value", "need", purchasing.buy_quantity("category", "value", "need", number).alias("buy_qty"), purchasing.buy_note("category", "value", "need", number).alias("note"))


@query
def substitutions(d):
    rows = d.events.select("category", "value").distinct()
    hint = F.when(F.col("category") == "Diodes", purchasing.diode_hint("value")).when(F.col("category") == "ICs", purchasing.ic_hint("value"))
    return rows.withColumn("hint", hint).where("hint IS NOT NULL")


@query
def hardware_injection(d):
    return purchasing.hardware(d.bill, d.projects)


@query
def germanium_rule(d):
    return purchasing.hardware(d.bill, d.projects).where("value = 'Germanium PNP'").select("value", "qty")


@query
def search_terms(d):
    rows = d.events.select("category", "value").distinct()
    rows = rows.withColumns({"number": U.parse_value("value", trimmed=True), "bare": bare_pot("value")})
    rows = rows.withColumns({"spec": U.spec_type("category", "value", F.col("number")), "pot": U.parse_value("bare", trimmed=True)})
    return rows.select("category", "value", search_term("category", "value", "spec", F.col("bare"), F.col("pot")).alias("search_term"))


@query
def vendor_urls(d):
    names = d.projects.select(F.concat("name", F.lit(" PCB")).alias("name")).distinct()
    return names.select("name", tayda_url("name").alias("tayda"), pedalpcb_url("name").alias("pedalpcb"))


@query
def stock_update(d):
    return shopping.stock_update(d.shopping)


@query
def excel_links(d):
    return shopping.csv_columns(d.shopping, excel=True)


@query
def origin_filter(d):
    return shopping.shopping_list(d.events, d.projects, d.stock, show_hardware=False, show_extras=False).select("origin", "category", "part", "bom_qty")


@query
def sort_inventory(d):
    return numbered(d.bill.select("category", "value"), *inventory.display_order(), "category")


@query
def z_height_order(d):
    rows = inventory.aggregate(d.events).withColumn("z", inventory.z_rank("category", "value"))
    return numbered(rows, "z", "first_slot", "category", "value").select("category", "value", "z", "place")


@query
def natural_sort(d):
    rows = d.scanned.where("fresh").select("ref").distinct().withColumn("k", R.natural_key("ref"))
    return numbered(rows, "k", "ref").select("ref", "place")


@query
def condense_refs(d):
    return condensed(inventory.marks(d.named), ["project", *inventory.KEY]).drop("n")


@query
def sticker_grid(d):
    return reports.stickers(d.named)


@query
def field_manual(d):
    sheet = reports.field_manual(d.named)
    return sheet.select("project", "category", "value", "qty", F.array_join("refs", ", ").alias("refs"), "notes", "polarized", "z", "shown_value", "shown_refs")


@query
def serialize_inventory(d):
    return reports.serialize_events(d.events)


@query
def slot_names(d):
    return dispatch.source_names(d.projects.drop("source").withColumn("slot_idx", F.col("slot"))).select("slot", "source")


@query
def locked_names(d):
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Title "), F.col("o_orderkey").cast("string")))  # two of three have none
    titles = d.table("orders").select(F.col("o_orderkey").alias("slot"), title.alias("title"))
    return dispatch.locked_names(d.projects.drop("source").withColumn("slot_idx", F.col("slot")), titles).select("slot", "locked_name")


@query
def total_stats(d):
    return ingest.total_stats(ingest.stats(d.scanned))


@query
def injection_warnings(d):
    old = inventory.aggregate(d.events).select("category", F.when(F.col("value") == "SOCKET8", "8 PIN DIP SOCKET").when(F.col("value") == "ADAPTER", "SMD_ADAPTER_BOARD").otherwise(F.col("value")).alias("value"), "qty")
    return purchasing.socket_warnings(old)


@query
def first_preset(d):
    return presets.first(presets.metadata(d.keys, "key"))


def _csv_texts(lines: DataFrame) -> DataFrame:
    """Each project's lines as one CSV text."""
    of = lines.select("slot", "ordinal", F.concat(F.regexp_extract("line", ingest.TOKEN, 1), F.lit(',"'), F.regexp_extract("line", ingest.TOKEN, 2), F.lit('"')).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "row"))), lambda x: x["row"]), "\r\n")
    return of.groupBy("slot").agg(F.concat(F.lit("\ufeffRef,Value\r\n"), body).alias("payload"))


@query
def csv_payloads(d):
    return ingest.stats(csv.scan_payloads(_csv_texts(d.lines).withColumn("source", F.lit("CSV"))))


@query
def dup_projects(d):
    return reports.duplicate_names(d.projects)


@query
def archive_manifest(d):
    return reports.manifest(d.projects.withColumn("locked_name", F.lit(None).cast("string")))


@query
def archive_sheets(d):
    """Written as an archive and read back from its shards."""
    path = storage.folder(d.spark, "archive")
    archive.write(archive.sheets(d.named), path)
    storage.until_exit(d.spark, path)
    return archive.read(d.spark, path)


@query
def clean_name(d):
    return d.keys.select("key", R.clean_name("key").alias("name"))


@query
def preset_metadata(d):
    return presets.metadata(d.keys, "key")


@query
def preset_categories(d):
    return presets.categories(presets.metadata(d.keys, "key")).select("source", F.explode("categories").alias("category"))


@query
def preset_labels(d):
    return presets.labels(presets.metadata(d.keys, "key"), source="Tayda")


@query
def page_route(d):
    pages = d.table("pages").select(F.col("page_id").alias("slot"), F.lit("From URL").alias("method"), F.col("html").alias("payload"), F.col("url").alias("path"))
    return dispatch.route(pages).select(F.col("slot").alias("page_id"), "kind")


@query
def csv_file_scan(d):
    """All documents written as one CSV folder, texts with their line breaks and quotes, and read back record by record."""
    folder = storage.folder(d.spark, "csv")
    docs = d.table("documents").select("doc_id", "text", "source")
    docs.write.csv(folder, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    storage.until_exit(d.spark, folder)
    back = csv.read(d.spark, f"{folder}/*.csv")
    text = F.coalesce("text", F.lit(""))
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


@query
def csv_scan(d):
    rows = d.lines.select(F.regexp_extract("line", ingest.TOKEN, 1).alias("Designator"), F.regexp_extract("line", ingest.TOKEN, 2).alias("Description"), "slot", "ordinal")
    scanned = csv.scan_bom(rows, slot=F.col("slot"), order=F.struct("ordinal.at1", "ordinal.at2", "ordinal.at3", "ordinal.at4"))
    return ingest.stats(scanned)


def _pages(d: Data) -> DataFrame:
    """All projects as pages: references and values as a table for even slots, as text for all."""
    of = d.lines.withColumn("pair", F.array(F.regexp_extract("line", ingest.TOKEN, 1), F.regexp_extract("line", ingest.TOKEN, 2)))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c))), lambda x: x[c])
    pages = of.groupBy("slot").agg(ordered("pair").alias("rows"), ordered("line").alias("text"))
    table = F.concat(F.array(F.array(F.lit("Location"), F.lit("Value"))), "rows")
    word = lambda t, size, x: F.struct(F.lit(t).alias("text"), F.lit(float(size)).alias("size"), F.lit(10.0).alias("top"), F.lit(float(x)).alias("x0"))
    words = F.array(word("Drive", 24, 60), word("Big", 24, 10), word("PEDALPCB", 30, 1), word("small", 8, 1))
    return pages.select("slot", F.lit("PDF").alias("source"), F.lit(0).alias("page"), F.array_join("text", "\n").alias("text"), F.when(F.col("slot") % 2 == 0, F.array(table)).otherwise(F.array().cast("array<array<array<string>>>")).alias("tables"), words.alias("words"))


@query
def pdf_tables(d):
    return pdf.table_rows(_pages(d)).where("ref_raw IS NOT NULL").select("slot", "ref_raw", "val_raw")


@query
def pdf_regex_scan(d):
    pages = _pages(d)
    return pdf.stats(pages, pdf.scan(pages))


@query
def mixed_intake(d):
    """All projects at once, by slot: pasted text, CSV uploads, PDF tables, and a method that does not exist."""
    of, kind = d.lines, F.col("slot") % 4
    one = of.groupBy("slot", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("text"))
    sheets = _csv_texts(of).withColumnRenamed("payload", "sheet")
    method = F.when(kind == 0, "Paste Text").when(kind == 1, "Upload File").when(kind == 3, "Fax")
    slots = one.join(sheets, "slot").select("slot", "source", method.alias("method"), F.when(kind == 1, F.col("sheet")).otherwise(F.col("text")).alias("payload"), F.when(kind == 1, "parts.csv").alias("path"))
    got = intake.take_in(slots.where("method IS NOT NULL"), _pages(d).where(kind == 2).withColumn("text", F.lit("")))
    return got["stats"].join(got["errors"], "slot", "left").select("slot", "lines_read", "parts_found", "error")


def _paper(content: bytes):
    """Pages that a query wrote as JSON, in place of a PDF's."""
    page = json.loads(content)
    yield page["text"], page["tables"], page["words"]


@query
def preset_crawl(d):
    """Every project as a file of a preset folder: two of three as PDFs, of which one in five has no title."""
    kind, slot = F.col("slot") % 3, F.col("slot").cast("string")
    words = F.when(F.col("slot") % 5 == 0, F.array().cast("array<struct<text:string,size:double,top:double,x0:double>>"))
    words = words.otherwise(F.transform("words", lambda w: w.withField("text", F.when(w["text"] == "Drive", F.concat(F.lit("Drive"), slot)).otherwise(w["text"]))))
    path = F.when(kind == 0, F.concat(F.lit("/lib/pedalpcb/fuzz/big_box-"), slot, F.lit(".pdf"))).when(kind == 1, F.concat(F.lit("/lib/tayda/big_box-"), slot, F.lit(".PDF"))).otherwise(F.concat(F.lit("/lib/loose_box-"), slot, F.lit(".txt")))
    paper = F.to_json(F.struct("text", "tables", words.alias("words")))
    files = _pages(d).select(path.alias("path"), F.when(kind == 2, F.col("text")).otherwise(paper).cast("binary").alias("content"))
    return library.compiled(files, "/lib", _paper)


@query
def pdf_title(d):
    return pdf.titles(_pages(d))
