"""Reference designators: ranges, natural order, condensing, and project names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, strip

RANGE = r"^([A-Z]+)([0-9]+)-([A-Z]+)?([0-9]+)"
LONGEST = 50


def expansion(rows: DataFrame, ref: str) -> DataFrame:
    """Adds what the references in column ``ref`` expand to: ``numbers`` of the members of a range, one null for a
    literal; ``base``, the members' prefix or the literal; ``shape``, the reference with a 0 for each run of digits.

    ``R1-R4`` has four members; spans of 50 and more stay literal; a backward range is empty. What several columns look
    at is a column of its own, so that it is computed once."""
    part = lambda i: F.regexp_extract("r_", RANGE, i)
    rows = rows.withColumn("r_", strip(ref))
    rows = rows.withColumn("e_", F.when(F.contains(F.col("r_"), F.lit("-")), F.when(F.col("r_").rlike(RANGE), F.struct(part(1).alias("p"), part(2).try_cast("bigint").alias("a"), part(4).try_cast("bigint").alias("b")))))
    rows = rows.withColumn("e_", F.when(F.col("e_.b") - F.col("e_.a") < LONGEST, F.col("e_")))
    first, last = F.col("e_.a"), F.col("e_.b")
    literal = F.array(F.lit(None).cast("bigint"))
    numbers = F.when(F.col("e_").isNull(), literal).when(last < first, F.array().cast("array<bigint>")).otherwise(F.sequence(first, F.greatest(first, last)))
    return rows.withColumns({
        "numbers": F.when(F.col("r_").isNotNull(), numbers),
        "base": F.coalesce("e_.p", "r_"),
        "shape": F.regexp_replace(F.coalesce(F.concat("e_.p", F.lit("0")), "r_"), "[0-9]+", "0"),
    }).drop("r_", "e_")


def member(pos: Column | str, number: Column | str, base: Column | str = "base") -> Column:
    """The reference at a place of an expansion that was exploded; null where there was nothing."""
    return F.when(col(pos).isNotNull(), F.concat(col(base), F.coalesce(col(number).cast("string"), F.lit(""))))


def expand(ref: Column | str) -> Column:
    """``R1-R4`` -> its members, as an array; for single columns. Tables are expanded by expansion()."""
    r = strip(ref)
    a, b = (F.regexp_extract(r, RANGE, i).try_cast("bigint") for i in (2, 4))
    ok = r.rlike(RANGE) & a.isNotNull() & b.isNotNull()
    members = F.transform(F.sequence(a, F.when(b - a < LONGEST, F.greatest(a, b)).otherwise(a)), lambda i: F.concat(F.regexp_extract(r, RANGE, 1), i.cast("string")))
    return F.when(ok & (b < a), F.array().cast("array<string>")).when(ok & (b - a < LONGEST), members).otherwise(F.array(r))


#: Ends a text in a natural key; in a text the mark is followed by another character.
END, MARK, ESCAPED = "\0\0", "\0", "\0\1"


def _digits(run: Column) -> Column:
    """A run of digits so that byte order is order of numbers: digits of its length's length, its length, itself."""
    bare = F.regexp_replace(run, "^0+", "")
    size = F.length(bare).cast("string")
    return F.when(run == "", "").otherwise(F.concat(F.length(size).cast("string"), size, bare))


def natural_key(ref: Column | str) -> Column:
    """Bytes whose order puts R2 before R10, whatever the length of a run of digits; 01 and 1 are equal.

    Texts and numbers alternate, texts first. A text ends so that it comes before longer ones it begins; no number
    comes before any. Most references are one text and one number, which needs no loop over pieces."""
    upper = F.upper(col(ref))
    piece = lambda p: F.concat(F.replace(F.regexp_extract(p, r"^(\D*)", 1), F.lit(MARK), F.lit(ESCAPED)), F.lit(END), _digits(F.regexp_extract(p, r"(\d*)$", 1)))
    pieces = F.filter(F.regexp_extract_all(upper, F.lit(r"(\D*\d*)"), F.lit(1)), lambda p: p != "")
    return F.when(upper.rlike(r"\A\D*\d+\z"), piece(upper)).otherwise(F.array_join(F.transform(pieces, piece), "")).cast("binary")


def in_natural_order(refs: Column) -> Column:
    """The references of an array without repeats, sorted; equal keys by their text."""
    return F.transform(F.sort_array(F.transform(refs, lambda r: F.struct(natural_key(r).alias("k"), r.alias("r")))), lambda x: x["r"])


def dedupe(refs: Column | str) -> Column:
    """Distinct references in natural order; equal keys by their text."""
    return in_natural_order(F.array_distinct(col(refs)))


#: A reference that runs are made of; what follows its number does not matter.
NUMBERED = r"^([a-zA-Z]+)([0-9]+)"


def number_of(ref: Column | str) -> Column:
    """(high, low) of a numbered reference: the last 18 digits of its number, and what stands before them ("" for most)."""
    bare = F.regexp_replace(F.regexp_extract(col(ref), NUMBERED, 2), "^0+", "")
    high = F.when(F.length(bare) > 18, F.substring(bare, F.lit(1), F.length(bare) - 18)).otherwise("")
    return F.struct(high.alias("high"), F.when(col(ref).rlike(NUMBERED), F.concat(F.lit("0"), F.right(bare, F.lit(18))).cast("bigint")).alias("low"))


def joined_runs(items: Column, follows, pair) -> Column:
    """``pair(first, last)`` of each stretch of an array whose every item ``follows`` the one before it."""

    def of(items: Column) -> Column:
        first = F.filter(items, lambda x, i: ~F.coalesce(follows(F.get(items, i - 1), x), F.lit(False)))
        last = F.filter(items, lambda x, i: ~F.coalesce(follows(x, F.get(items, i + 1)), F.lit(False)))
        return F.zip_with(first, last, pair)

    # bound as a lambda's variable, so that the array is made once and not for each of its elements
    return F.get(F.transform(F.array(items), of), F.lit(0))


def condense(refs: Column | str) -> Column:
    """[R1, R2, R3, C1] -> ``C1, R1-R3``. References without a number come first; a repeat ends a run, and so does the
    carry into a number's nineteenth digit. operators.condensing does it for references that are rows."""
    refs = col(refs)
    odd = F.array_sort(F.filter(refs, lambda r: ~r.rlike(NUMBERED)))
    one = lambda r, n: F.struct(F.regexp_extract(r, NUMBERED, 1).alias("p"), F.length(n["high"]).alias("size"), n["high"].alias("high"), n["low"].alias("n"))
    known = F.array_sort(F.transform(F.filter(refs, lambda r: r.rlike(NUMBERED)), lambda r: one(r, number_of(r))))
    follows = lambda a, b: (a["p"] == b["p"]) & (a["high"] == b["high"]) & (a["n"] + 1 == b["n"])
    name = lambda x: F.concat(x["p"], x["high"], F.when(x["high"] == "", x["n"].cast("string")).otherwise(F.lpad(x["n"].cast("string"), 18, "0")))
    same = lambda a, b: (a["high"] == b["high"]) & (a["n"] == b["n"])
    return F.array_join(F.concat(odd, joined_runs(known, follows, lambda a, b: F.when(same(a, b), name(a)).otherwise(F.concat(name(a), F.lit("-"), name(b))))), ", ")


PRESET_KEY = r"(?d)^\[(.*?)\] (?:\[(.*?)\] )?(.*)$"


def clean_name(key: Column | str) -> Column:
    """``[Source] [Category] Name`` -> ``Name - Source``; anything else as it is."""
    k = col(key)
    return F.when(k.rlike(PRESET_KEY), F.concat(F.regexp_extract(k, PRESET_KEY, 3), F.lit(" - "), F.regexp_extract(k, PRESET_KEY, 1))).otherwise(k)


def project_code(name: Column | str) -> Column:
    return F.substring(F.upper(F.regexp_replace(col(name), r"[^\p{L}\p{N}]", "")), 1, 4)


def safe_filename(name: Column | str) -> Column:
    return strip(F.regexp_replace(col(name), r'[<>:"/\\|?*]', ""))
