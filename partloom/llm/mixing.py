"""Mixing sources to target word counts by weighted pivotal rounding over a reduction tree.

A source's target over its size is the expected number of copies of each of its documents. The whole part is
taken as it is; of the fractional parts, two documents at a time move words from one to the other, at random and
without bias, until one of them is all in or all out. Words are kept exactly in every move. A group of rows ends
with one undecided document at most; those meet in groups sixteen times fewer, level by level, and the last one
of a source is settled by its own probability; single documents of that last group then change over wherever that
brings the source nearer to its target. Large documents come first: later moves settle them, so what stays
undecided tends to be small, and a source's words end near its target. Groups hang on a hash of the id, so reruns agree on any layout.

Rows alike in id, text and source are one unit with as many copies as they get together: its whole part and one
fraction. So no group grows with the copies of a document, and what is dealt is counted before.

Defined cases: null text has no words; documents without words are taken by their own probability and count
nothing; null sources are a source of their own, last in order; repeated rows are rows, and the copies of those
alike are dealt evenly; the same id and text in two sources are two documents; an empty table gives no rows; other
columns may have any name and type.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import lean, named, runs, save, tune

FAN_IN = 16
PIECE = 1 << 16  # rows that one row is multiplied into at once


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, rows, sid, target) per source of ``sized`` (source, size, n): n rows of that size each.

    All share by weight; sources above their cap stop there, and the rest is shared anew until none is above. Every
    round is one aggregate over the sources, and a source that is capped stays so."""
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    per = numbered(per, F.col("source").asc_nulls_last(), name="sid").withColumn("sid", F.col("sid") - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = save(per.withColumn("w", pick).withColumn("cap", most * F.col("source_size")), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        capped = F.col("w") * level >= F.col("cap")
        used, free, n = per.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w"))), F.count(F.when(capped, 1))).first()
        if not free or n == held:
            break
        level, held = (total - (used or 0.0)) / free, n
    return per.select("source", "source_size", "rows", "sid", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def _draw(a: int, b: int) -> float:
    x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x >> 11) / (1 << 53)


def pivot(size: list[int], x: list[float], h: list[int], last: bool) -> None:
    """Settle the fractional ``x`` in place, all but one; that one too if ``last``.

    The last one leaves an error of up to its size. From the largest on, documents whose other value brings the words
    nearer to what they were change it, each at most once."""
    held, mine, words = -1, [j for j in range(len(x)) if 1e-9 < x[j] < 1 - 1e-9 and size[j]], sum(map(operator.mul, size, x))
    for j in range(len(x)):
        if not 1e-9 < x[j] < 1 - 1e-9:
            x[j] = float(round(x[j]))
            continue
        if size[j] == 0:
            x[j] = float(_draw(h[j], 1) < x[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        up, down = min((1 - x[i]) * size[i], x[j] * size[j]), min(x[i] * size[i], (1 - x[j]) * size[j])
        d = up if _draw(h[i], h[j]) * (up + down) < down else -down
        x[i] += d / size[i]
        x[j] -= d / size[j]
        still = [k for k in (i, j) if 1e-9 < x[k] < 1 - 1e-9]
        for k in (i, j):
            if k not in still:
                x[k] = float(round(x[k]))
        held = still[0] if still else -1
    if last and held >= 0:
        x[held] = float(_draw(h[held], 2) < x[held])
        over = sum(map(operator.mul, size, x)) - words
        for j in sorted(mine, key=lambda j: (-size[j], h[j])):
            d = size[j] * (1 - 2 * x[j])
            if abs(over + d) < abs(over):
                x[j], over = 1 - x[j], over + d


def _level(rows: DataFrame, shift: int, last: bool) -> DataFrame:
    g = F.shiftright("salt", shift)
    dealt = rows.withColumn("g", g).repartition("sid", "g").sortWithinPartitions("sid", "g", F.desc("size"), "h", "id", "key")

    @lean
    def run(batches):
        for t in runs(batches, ["sid", "g"]):
            t = t.combine_chunks()
            sid, g, size, x, h = (t.column(c).to_numpy() for c in ("sid", "g", "size", "x", "h"))
            cut = np.flatnonzero((np.diff(sid) != 0) | (np.diff(g) != 0)) + 1
            out = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True):
                part = x[a:b].tolist()
                pivot(size[a:b].tolist(), part, h[a:b].view(np.uint64).tolist(), last)
                out += part
            t = t.set_column(t.schema.get_field_index("x"), "x", pa.array(out, pa.float64())).drop_columns(["g"])
            yield from t.to_batches()

    return dealt.mapInArrow(run, rows.schema)


BY = ["id", "key", "source"]


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str, other=None) -> DataFrame:
    """(id, key, source, size, n), and ``other`` if given: rows alike in these are one unit, counted before the exchange."""
    text = named(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")
    cols = [named(id_col).alias("id"), F.xxhash64(text).alias("key"), named(source_col).alias("source"), size.alias("size"), *([] if other is None else [other.alias("other")])]
    rows = docs.select(*cols)
    return save(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "units")


def _decided(units: DataFrame, weights: tuple[int, ...], most: float, seed: int, group_rows: int) -> DataFrame:
    """``units`` (id, key, source, size, n) with source_size, target, and the copies that a unit's rows get together."""
    per = save(targets(units, weights, most), "targets")
    biggest = per.agg(F.max("rows")).first()[0] or 0
    salts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("rows") / group_rows, F.lit(1.0))))).cast("bigint")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")
    rows = units.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(*units.columns, "source_size", "target", "sid", F.xxhash64("id", "key", F.lit(seed)).alias("h"), salts.alias("salts"), each.alias("each"))
    rows = rows.select(*units.columns, "source_size", "target", "sid", "h", F.pmod(F.xxhash64("h"), "salts").alias("salt"), F.floor("each").alias("whole"), (F.col("each") - F.floor("each")).alias("x"))
    levels = max(0, math.ceil(math.log2(max(biggest / group_rows, 1)))) if biggest else 0
    done, shift = [], 0
    while True:
        last = shift >= levels
        rows = save(_level(rows, shift, last), "mixed")
        done.append(rows.where(F.col("x").isin(0.0, 1.0)))
        if last:
            break
        rows = rows.where(~F.col("x").isin(0.0, 1.0))
        shift = min(shift + int(math.log2(FAN_IN)), levels)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select(*units.columns, "source_size", "target", (F.col("whole") + F.col("x")).cast("bigint").alias("copies"))


def _spread(rows: DataFrame, times) -> DataFrame:
    """Each row as often as ``times`` tells, numbered ``i`` from 0; rows that come very often are cut and dealt first."""
    rows = rows.withColumn("times", times.cast("bigint")).where("times > 0")
    few = rows.where(F.col("times") <= PIECE).withColumn("from", F.lit(0).cast("bigint"))
    many = rows.where(F.col("times") > PIECE).withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1, F.lit(PIECE).cast("bigint"))))
    many = many.withColumn("times", F.least(F.lit(PIECE).cast("bigint"), F.col("times") - F.col("from"))).repartition("from")
    return few.unionByName(many).withColumn("i", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("times") - 1))).drop("from", "times")


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, group_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, key, source, size, source_size, target, copies) for every row; ``key`` is a hash of the row's text."""
    tune(docs.sparkSession)
    decided = _decided(_units(docs, id_col, text_col, source_col), weights, most, seed, group_rows)
    one = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("i") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return _spread(decided, F.col("n")).select(*BY, "size", "source_size", "target", one.cast("bigint").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, group_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row as often as it is taken, with its columns.

    A row is found again by its id, the hash of its text, its source and a hash of all its other columns; rows alike in
    all four are one row. Where rows differ in the last alone, they share the copies of their unit, in its order."""
    tune(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_col, text_col, source_col)]
    other = F.xxhash64(F.to_json(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(others)]), {"ignoreNullFields": "false"})) if others else F.lit(0).cast("bigint")
    rows = _units(docs, id_col, text_col, source_col, other)
    units = save(rows.groupBy(*BY, "size").agg(F.sum("n").alias("n")), "units")
    decided = _decided(units, weights, most, seed, group_rows)
    if rows.count() > units.count():
        # places of a unit's rows: after those of smaller salts, then after those of smaller hashes
        rows = rows.withColumn("salt", F.pmod("other", F.lit(64)))
        salts = rows.groupBy(*BY, "salt").agg(F.sum("n").alias("sn")).select(*BY, "salt", (F.sum("sn").over(Window.partitionBy(*BY).orderBy("salt")) - F.col("sn")).alias("before"))
        rows = rows.withColumn("place", F.sum("n").over(Window.partitionBy(*BY, "salt").orderBy("other")) - F.col("n"))
        rows = rows.join(*_same(salts, [*BY, "salt"])).select(*BY, "other", "n", (F.col("place") + F.col("before")).alias("place"))
    else:
        rows = rows.select(*BY, "other", "n", F.lit(0).cast("bigint").alias("place"))
    rows = rows.join(*_same(decided.select(*BY, F.col("n").alias("all"), "copies").where("copies > 0"), BY))
    rest = F.greatest(F.lit(0), F.least(F.col("n"), F.col("copies") % F.col("all") - F.col("place")))
    wanted = rows.select(*BY, "other", (F.col("n") * F.floor(F.col("copies") / F.col("all")) + rest).cast("bigint").alias("own")).where("own > 0")
    keyed = docs.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("key"), named(source_col).alias("source"), other.alias("other"))
    if not rows.where("n > 1").isEmpty():
        keyed = keyed.groupBy(*BY, "other").agg(F.first("row").alias("row"))
    taken = _spread(keyed.join(*_same(wanted, [*BY, "other"])).select("row", "own"), F.col("own"))
    return taken.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _same(other: DataFrame, by: list[str]) -> tuple:
    """Arguments of a join on ``by``, where null equals null; the other side's keys are dropped by renaming."""
    renamed = other.select(*[F.col(c).alias(f"{c}_of") if c in by else F.col(c) for c in other.columns])
    return renamed, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]
