"""PDF pages: tables, then a scan of their text, and the title.

``pages``: (slot, source, page, text, tables ARRAY<ARRAY<ARRAY<STRING>>>, words ARRAY<STRUCT<text, size, top, x0>>).
All parsing is expressions; only reading bytes needs Python, in extract().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.knowledge import IGNORE_VALUES, KEYWORDS, PDF_PREFIXES, TITLE_IGNORE
from ..functions.text import contains_any, has_digit, starts_any, strip
from ..operators.ingest import resolve
from ..storage import save

SCHEMA = "slot bigint, source string, page int, text string, tables array<array<array<string>>>, words array<struct<text:string,size:double,top:double,x0:double>>"
REF_HEADS, VALUE_HEADS = ["LOCATION", "REF", "DESIGNATOR", "PART"], ["VALUE", "VAL", "DESCRIPTION"]


def _ordinal(phase: int, *parts):
    return F.struct(F.lit(phase).alias("phase"), *[p.cast("bigint").alias(f"k{i}") for i, p in enumerate(parts)])


def table_rows(pages: DataFrame) -> DataFrame:
    """Candidates of all table rows; ``ref_raw`` is null where a row gives none."""
    tables = pages.select("slot", "source", "page", F.posexplode("tables").alias("table_no", "t")).where(F.size("t") > 0)
    cell = lambda c: F.coalesce(c, F.lit(""))
    heads = F.transform(F.filter(F.col("t")[0], lambda h: cell(h) != ""), lambda h: strip(F.upper(h)))
    last = lambda names: F.array_max(F.filter(F.transform("heads", lambda h, i: F.when(h.isin(names), i)), lambda i: i.isNotNull()))
    tables = tables.withColumn("heads", heads).withColumns({"ri": last(REF_HEADS), "vi": last(VALUE_HEADS)})
    named = F.col("ri").isNotNull() & F.col("vi").isNotNull()
    tables = tables.select("slot", "source", "page", "table_no", "t", F.when(named, F.col("ri")).otherwise(0).alias("ri"), F.when(named, F.col("vi")).otherwise(1).alias("vi"), F.when(named, 1).otherwise(0).alias("from"))
    rows = tables.select("slot", "source", "page", "table_no", "ri", "vi", "from", F.posexplode("t").alias("row_no", "r")).where(F.col("row_no") >= F.col("from"))
    rows = rows.withColumn("r", F.transform("r", cell))
    first = F.coalesce(F.get(F.filter("r", lambda c: c != ""), F.lit(0)), F.lit(""))
    flat = lambda i: strip(F.replace(F.get("r", F.col(i)), F.lit("\n"), F.lit(" ")))
    wide = F.size("r") > F.greatest("ri", "vi")
    lone = (F.size("r") == 1) & ~wide
    split = F.split(strip(F.get("r", F.lit(0))), r"(?U)\s+", 2)
    ref = F.when(wide, flat("ri")).when(lone & (F.size(split) == 2), strip(F.get(split, F.lit(0))))
    value = F.when(wide, flat("vi")).when(lone & (F.size(split) == 2), strip(F.get(split, F.lit(1))))
    ok = ~first.rlike(r"(?U)^[0-9]+\s*[xX]") & (F.coalesce(ref, F.lit("")) != "") & (F.coalesce(value, F.lit("")) != "")
    return rows.select("slot", "source", _ordinal(0, F.col("page"), F.col("table_no"), F.col("row_no")).alias("ordinal"), F.when(ok, ref).alias("ref_raw"), F.when(ok, value).alias("val_raw"))


def text_matches(pages: DataFrame, strict: bool) -> DataFrame:
    """Candidates of the page text: references or control names, each followed by a value; null where unusable."""
    words = "|".join(rf"\b{k}\b" for k in KEYWORDS)
    ref = words if strict else rf"\b[A-Z]{{1,4}}\d+\b|{words}"
    # matches are cut apart at a pair of characters that no text has: the first is doubled up differently where it has it
    escaped = F.replace("text", F.lit("\u0001"), F.lit("\u0001\u0002"))
    mark = F.regexp_replace(escaped, rf"(?iuU)((?:{ref})\s+\S+)", "\u0001\u0003$1")
    parts = pages.where("text <> ''").select("slot", "source", "page", F.posexplode(F.split(mark, "\u0001\u0003")).alias("match_no", "part")).where("match_no > 0")
    parts = parts.withColumn("part", F.replace("part", F.lit("\u0001\u0002"), F.lit("\u0001")))
    whole = rf"(?iuUs)^({ref})\s+(.*)$"
    r, rest = F.upper(F.regexp_extract("part", whole, 1)), F.regexp_extract("part", whole, 2)
    parts = parts.select("slot", "source", "page", "match_no", r.alias("ref_raw"), rest.alias("rest"))
    keyword = F.col("ref_raw").isin(KEYWORDS)
    v = F.when(keyword | starts_any(F.col("ref_raw"), ["LDR", "POT", "VR"]), strip(F.regexp_extract("rest", r"(?d)^([^\n]*)", 1))).otherwise(F.regexp_extract("rest", r"(?U)^(\S+)", 1))
    parts = parts.withColumns({"raw": v, "keyword": keyword})
    raw = F.col("raw")
    bare = F.when(raw.rlike(r"(?s)^\(.*\)$|^\[.*\]$"), strip(F.substring(raw, F.lit(2), F.length(raw) - 2))).otherwise(raw)
    parts = parts.withColumn("val_raw", bare).withColumn("up", F.upper("val_raw"))
    val, up, name = F.col("val_raw"), F.col("up"), F.col("ref_raw")
    usable = F.length(val).between(1, 50) & ~contains_any(up, IGNORE_VALUES) & ~val.rlike(r"(?iU)^(?:is|see|note)\s") & ~val.rlike(r"^[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}")
    plain = starts_any(name, PDF_PREFIXES) & ~((F.length(name) >= 3) & val.rlike("^[0-9]+$"))
    control = (has_digit(val) | up.rlike("SPDT|DPDT|3PDT|ON/ON|ON/OFF")) & ~starts_any(up, ["IC", "DIP", "SOIC", "PKG", "MODULE", "PCB", "TL", "OP", "NE5"]) & ~(up.rlike("DIP|SOIC") & ~has_digit(val))
    parts = parts.withColumn("ok", usable & F.when(F.col("keyword"), control).otherwise(plain))
    # nulls rather than a filter: that would be pushed down, and carry all of the above along
    return parts.select("slot", "source", _ordinal(1, F.col("page"), F.col("match_no"), F.lit(0)).alias("ordinal"), F.when(F.col("ok"), name).alias("ref_raw"), F.when(F.col("ok"), val).alias("val_raw"))


def scan(pages: DataFrame) -> DataFrame:
    """All candidates resolved: tables first, then text, which is read loosely where no table gave a part.

    Candidates are written: Spark would put the expressions that give them into all that looks at them, and what pages and
    the first look at tables shuffle goes before the second look."""
    tables = save(table_rows(pages), "tables")
    by_table = resolve(tables).groupBy("slot").agg(F.max("valid").alias("some"))
    have = save(by_table.where("some").select("slot"), "have")
    loose = save(text_matches(pages.join(have, "slot", "left_anti"), strict=False), "loose")
    strict = save(text_matches(pages.join(have, "slot", "left_semi"), strict=True), "strict")
    return resolve(tables.unionByName(loose).unionByName(strict))


def stats(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """(slot, lines_read, parts_found) of all slots of ``pages``: lines are table rows."""
    read = F.sum(((F.col("ordinal.phase") == 0) & (F.coalesce("pos", F.lit(0)) == 0)).cast("bigint"))
    counted = resolved.groupBy("slot").agg(read.alias("lines_read"), F.sum(F.col("valid").cast("bigint")).alias("parts_found"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return pages.select("slot").distinct().join(counted, "slot", "left").select("slot", zero("lines_read"), zero("parts_found"))


def titles(pages: DataFrame) -> DataFrame:
    """(slot, title): the largest words of the first page, in reading order."""
    w = pages.where("page = 0").select("slot", F.posexplode("words").alias("at", "w")).select("slot", "at", "w.*")
    w = w.where((F.col("size") > 10) & ~F.upper("text").isin(TITLE_IGNORE))
    w = w.withColumn("most", F.max("size").over(Window.partitionBy("slot"))).where("size >= most - 1")
    ordered = F.array_sort(F.collect_list(F.struct("top", "x0", "at", "text")))
    return w.groupBy("slot").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("title"))


def plumbed(content: bytes):
    """Pages of a file as (text, tables, words), by pdfplumber: words of the first page alone, for the title."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as doc:
        for n, p in enumerate(doc.pages):
            words = [{k: w[k] for k in ("text", "size", "top", "x0")} for w in p.extract_words(extra_attrs=["size"])] if n == 0 else []
            yield p.extract_text() or "", p.extract_tables() or [], words


def extract(files: DataFrame, reader=plumbed) -> DataFrame:
    """(slot, source, content) -> pages with an ``error``. ``reader`` turns a file's bytes into pages, one at a time: if
    it fails before the first the file could not be read, else that page could not, and those before it stay."""
    fields = f"{SCHEMA}, error string"

    def run(frames):
        for pdf in frames:
            out = []
            for slot, source, content in zip(pdf["slot"], pdf["source"], pdf["content"], strict=True):
                n = 0
                try:
                    for text, tables, words in reader(bytes(content)):
                        out.append((slot, source, n, text, tables, words, None))
                        n += 1
                except ImportError:
                    out.append((slot, source, n, None, None, None, "File Error: no PDF reader is installed"))
                except Exception as e:  # whatever a damaged file makes the reader raise is the slot's error
                    out.append((slot, source, n, None, None, None, f"{'Parse' if n else 'File'} Error: {e}"))
            yield type(pdf)(out, columns=["slot", "source", "page", "text", "tables", "words", "error"])

    return files.select("slot", "source", "content").mapInPandas(run, fields)
