"""Purchase quantities and notes, and the hardware that every project needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.knowledge import AUTO_SOURCE, DIODE_SUBSTITUTES, GERMANIUM, HARDWARE, IC_SUBSTITUTES, NOTES, POT_HARDWARE, substitutes
from ..functions.text import col
from ..functions.units import parse_value, spec_type


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def diode_hint(value: Column | str) -> Column:
    return _lookup(col(value), substitutes(DIODE_SUBSTITUTES))


def ic_hint(value: Column | str) -> Column:
    """By the chip's name without one trailing package code."""
    return _lookup(F.regexp_replace(col(value), "(?:CP|CN|P|N)$", ""), substitutes(IC_SUBSTITUTES))


def buy_quantity(category: Column | str, value: Column | str, need: Column | str, number: Column | None = None) -> Column:
    c, v, n, f = col(category), col(value), col(need), parse_value(value) if number is None else number
    cap = F.when(F.abs(f - 1e-7) < 1e-9, 10).when(f >= 1e-6, 1).otherwise(5)
    out = (
        F.when(c == "Resistors", F.ceil((n + 5) / 10).cast("bigint") * 10)
        .when(c.isin("Optoelectronics", "Transistors", "Crystals/Oscillators"), n + 1)
        .when(c == "Capacitors", n + cap)
        .when(c == "Diodes", F.greatest(F.lit(10), n + 5))
        .when((c == "Hardware/Misc") & v.rlike("ADAPTER|SOCKET"), n + 1)
        .otherwise(n)
    )
    return F.when(n <= 0, 0).otherwise(out).cast("bigint")


def buy_note(category: Column | str, value: Column | str, need: Column | str, number: Column | None = None) -> Column:
    c, v, n, f = col(category), col(value), col(need), parse_value(value) if number is None else number
    up, spec = F.upper(v), spec_type(category, value, f)
    kind = (
        F.when(spec == "", None)
        .when((spec == "Box Film") & (F.abs(f - 1e-6) < 1e-9), NOTES["cap_1u"])
        .when(spec == "MLCC", NOTES["cap_mlcc"])
        .otherwise(F.concat(F.lit(NOTES["cap"]), spec))
    )
    cap = F.concat_ws(" | ", F.when(F.abs(f - 1e-7) < 1e-9, NOTES["bypass"]), F.when(f > 0.01, NOTES["cap_high"]), kind)
    out = (
        F.when(c == "Resistors", F.when(f < 1, NOTES["resistor_low"]).otherwise(NOTES["resistor"]))
        .when(c == "Capacitors", cap)
        .when(c == "Diodes", F.coalesce(diode_hint(v), F.lit("")))
        .when(c == "Transistors", F.when(F.contains(up, F.lit("2N5457")), NOTES["obsolete"]).when(F.contains(up, F.lit("MMBF")), NOTES["smd"]).otherwise(""))
        .when(c == "ICs", F.concat_ws(" | ", F.lit(NOTES["ic"]), ic_hint(v)))
        .when(c == "Crystals/Oscillators", NOTES["crystal"])
        .when(c == "Hardware/Misc", F.when(F.contains(v, F.lit("ADAPTER")), NOTES["adapter"]).when(F.contains(v, F.lit("SOCKET")), NOTES["socket"]).otherwise(""))
        .when(c == "PCB", NOTES["pcb"])
        .otherwise("")
    )
    return F.when(n <= 0, "").otherwise(out)


def kit(spark, projects: DataFrame) -> DataFrame:
    """(category, value, qty, note) of the fixed kit, times the projects' counts."""
    rows = spark.createDataFrame(HARDWARE, "category string, value string, each bigint, note string")
    pedals = projects.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("pedals"))
    return rows.select("category", "value", (F.col("each") * pedals.scalar()).alias("qty"), "note")


def hardware(bom: DataFrame, projects: DataFrame) -> DataFrame:
    """(category, value, qty, note): the kit times the projects' counts; a fuzz board asks for a vintage transistor,
    pots for knobs and seals."""
    seen = bom.agg(
        F.coalesce(F.sum(F.when(F.col("category").startswith("Potentiometers"), F.col("qty"))), F.lit(0)).alias("pots"),
        F.coalesce(F.max(F.when(F.col("category").startswith("PCB"), F.contains(F.upper(F.concat_ws(" | ", "category", "value")), F.lit("FUZZ")))), F.lit(False)).alias("fuzz"),
    )
    extra = [F.struct(*[F.lit(x) for x in (GERMANIUM[0], GERMANIUM[1])], F.lit(0).cast("bigint"), F.lit(GERMANIUM[2]), F.col("fuzz"))]
    for name, label in POT_HARDWARE:
        extra.append(F.struct(F.lit("Hardware/Misc"), F.lit(name), F.col("pots"), F.concat(F.lit(label), F.lit(" ("), F.col("pots").cast("string"), F.lit(")")), F.col("pots") > 0))
    names = "struct<category:string,value:string,qty:bigint,note:string,wanted:boolean>"
    extra = seen.select(F.explode(F.array(*[e.cast(names) for e in extra])).alias("e")).select("e.*").where("wanted").drop("wanted")
    return kit(bom.sparkSession, projects).unionByName(extra)


def socket_warnings(bom: DataFrame) -> DataFrame:
    """Warnings for adapter boards and sockets that an inventory holds in their old names."""
    told = {"SMD_ADAPTER_BOARD": "⚠️  SMD ADAPTERS: Added for MMBF5457. Check if your PCB has SOT-23 pads first.", "8 PIN DIP SOCKET": "ℹ️  IC SOCKETS: Added sockets for chips. Optional but recommended."}  # noqa: RUF001
    return bom.where((F.col("category") == "Hardware/Misc") & F.col("value").isin(list(told)) & (F.col("qty") > 0)).select(_lookup(F.col("value"), told).alias("warning"))


AUTO = AUTO_SOURCE
