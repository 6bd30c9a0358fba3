"""From candidate references to part events, rejected lines and statistics.

Rows carry ``slot`` (one project's input) and ``ordinal`` (a struct that orders its lines). What depends on order is a
window within a slot's reference, what depends on a whole line a window within a slot's line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.knowledge import SAFE_WORDS
from ..functions.refs import expansion, member
from ..functions.text import contains_any, has_digit
from ..storage import save
from .classify import SOCKET_CATEGORY, SOCKET_VALUE, with_class

#: A reference, a separator, the first word of a value.
TOKEN = r"(?Ud)^([a-zA-Z0-9_\-]+)[\s,]+([0-9a-zA-Z./\-]+)"


def classes(candidates: DataFrame) -> DataFrame:
    """(shape, val_raw, category, value, socket) of the different pairs. A reference's numbers decide nothing but that
    there are some, so its shape has one digit for each run of them, and pairs are as many as labels and values.

    They are written, so that Spark knows their size when it plans the join: else it deals all candidates by pair before it
    finds that it could have sent the pairs to them."""
    pairs = candidates.select("shape", "val_raw").distinct()
    return save(with_class(pairs, "shape").select(F.col("shape").alias("shape_"), F.col("val_raw").alias("val_"), "category", "value", "socket"), "classes")


def dealt(candidates: DataFrame) -> DataFrame:
    """Candidates dealt by line. For those that long expressions give: Spark would put these into all that looks at them,
    and an exchange is where it stops."""
    return candidates.repartition("slot", "ordinal")


def resolve(candidates: DataFrame) -> DataFrame:
    """Expand, keep the first sighting of each reference in its slot, classify.

    ``candidates`` (slot, ordinal, ref_raw, val_raw, ...) give one row per expanded reference, or one with a null
    ``ref``; ``valid`` tells the parts, ``found`` how many the candidate's line has. A slot may be of any size: what is
    first is told within (slot, reference), what a line has within (slot, line); input that is dealt by slot already is
    not dealt again.
    """
    rows = expansion(candidates, "ref_raw")
    rows = rows.join(classes(rows), F.col("shape").eqNullSafe(F.col("shape_")) & F.col("val_raw").eqNullSafe(F.col("val_")), "left").drop("shape_", "val_")
    rows = rows.select("*", F.posexplode_outer("numbers").alias("pos", "number")).withColumn("ref", member("pos", "number"))
    # lines without a reference are no group of their own
    apart = F.when(F.col("ref").isNull(), F.xxhash64("ordinal"))
    first = F.row_number().over(Window.partitionBy("slot", "ref", apart).orderBy("ordinal", "pos")) == 1
    rows = rows.withColumn("fresh", first & F.col("ref").isNotNull()).drop("numbers", "number", "base", "shape")
    rows = rows.withColumn("valid", F.col("fresh") & F.col("category").isNotNull())
    found = F.sum(F.col("valid").cast("bigint")).over(Window.partitionBy("slot", "ordinal"))
    return rows.withColumn("found", F.coalesce(found, F.lit(0)))


def _events(rows: DataFrame, boards: bool) -> DataFrame:
    """All events of a resolved row at once: the part, the socket of a chip, the board a line names."""
    one = lambda category, value, ref, kind: F.struct(category.alias("category"), value.alias("value"), ref.alias("ref"), F.lit(kind).alias("kind"))
    each = [
        F.when(F.col("valid"), one(F.col("category"), F.col("value"), F.col("ref"), "part")),
        F.when(F.col("valid") & F.col("socket"), one(F.lit(SOCKET_CATEGORY), F.lit(SOCKET_VALUE), F.concat(F.col("ref"), F.lit(" (Inj)")), "socket")),
    ]
    if boards:
        each.append(F.when(F.col("pcb").isNotNull(), one(F.lit("PCB"), F.col("pcb"), F.lit(""), "pcb")))
    out = rows.select("slot", "source", "ordinal", F.coalesce("pos", F.lit(0)).alias("pos"), F.explode(F.array_compact(F.array(*each))).alias("e"))
    return out.select("slot", "source", "ordinal", "pos", "e.category", "e.value", "e.ref", F.lit(1).cast("bigint").alias("qty"), "e.kind")


def events_of(rows: DataFrame) -> DataFrame:
    """Part events, with one more for the socket of a chip."""
    return _events(rows, boards=False)


def scan_lines(lines: DataFrame) -> DataFrame:
    """Lines (slot, source, ordinal, line) resolved, with ``pcb``: the name that a board line or fallback gives."""
    head = F.upper(F.regexp_extract("line", r"(?U)^(\S+)", 1))
    name = F.regexp_extract("line", r"(?Uds)^\S+\s+(.*)$", 1)
    board = head == "PCB"
    token = ~board & F.col("line").rlike(TOKEN)
    # what a fallback takes of a line is a column of its own: bills that need no more do not sort whole lines
    fallback = F.when(~board & F.contains(F.upper("line"), F.lit("PCB")), F.col("line"))
    rows = lines.withColumns({
        "board": board,
        "named": F.when(board & (name != ""), name),
        "fallback": fallback,
        "ref_raw": F.when(token, F.upper(F.regexp_extract("line", TOKEN, 1))),
        "val_raw": F.when(token, F.regexp_extract("line", TOKEN, 2)),
    })
    rows = resolve(rows)
    none, first = F.col("found") == 0, F.coalesce("pos", F.lit(0)) == 0
    return rows.withColumns({
        "pcb": F.when(first, F.coalesce("named", F.when(none, F.col("fallback")))),
        "rejected": ~F.col("board") & none & F.col("fallback").isNull() & first,
    }).drop("fallback")


def text_events(scanned: DataFrame) -> DataFrame:
    """Part events and boards of scanned lines, in one pass."""
    return _events(scanned, boards=True)


def residuals(scanned: DataFrame) -> DataFrame:
    return scanned.where("rejected").select("slot", "source", "ordinal", "line")


def suspicious(rejected: DataFrame, line: str = "line") -> DataFrame:
    """Rejected lines that may hold a part: errors, and non-headings with a digit."""
    up = F.upper(line)
    return rejected.where(up.rlike("ERROR|EXCEPTION") | (~contains_any(up, SAFE_WORDS) & has_digit(F.col(line))))


def stats(scanned: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """(slot, lines_read, parts_found, residuals) of text or CSV rows resolved; zeros for those of ``slots`` without any."""
    if slots is not None:
        counted = stats(scanned)
        zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counted.columns if c != "slot"]
        return slots.select("slot").distinct().join(counted, "slot", "left").select("slot", *zeros)
    one = F.coalesce("pos", F.lit(0)) == 0
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias
    return scanned.groupBy("slot").agg(count(one)("lines_read"), count(F.col("valid") | F.col("pcb").isNotNull())("parts_found"), count(F.col("rejected"))("residuals"))


def total_stats(per_slot: DataFrame) -> DataFrame:
    """One row over all slots."""
    return per_slot.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("lines_read", "parts_found", "residuals")])
