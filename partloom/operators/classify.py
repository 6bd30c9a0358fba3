"""Classification of a reference and its value as one conditional expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.knowledge import CLASSIFIER_PREFIXES, NO_SOCKET, POT_LABELS, SOCKET, SWITCH_LABELS, TAPERS
from ..functions.text import col, contains_any, has_digit, starts_any, strip
from ..functions.units import normalize, parse_value


def category_of(ref: Column | str, value: Column | str) -> Column:
    """Category name, or null for what is not a part."""
    return _category(strip(F.upper(col(ref))), F.upper(strip(value)))


def _category(r: Column, v: Column) -> Column:
    tapers = "".join(TAPERS)
    like_pot = ~starts_any(r, ["IC", "U", "Q", "OP", "TL"]) & v.rlike(f"(?d)[0-9].*[{tapers}]$|^[{tapers}][0-9]")
    pot = starts_any(r, POT_LABELS) | like_pot
    switch = r.isin(SWITCH_LABELS)
    known = (starts_any(r, CLASSIFIER_PREFIXES) & has_digit(r)) | pot | switch | (r == "CLR")
    starts = lambda *p: starts_any(r, list(p))
    return (
        F.when(~known, None)
        .when(starts("LDR"), "Optoelectronics")
        .when(pot, "Potentiometers")
        .when(switch, F.when(v.rlike("ON|SW|SP|DP"), "Switches").otherwise("Potentiometers"))
        .when((r == "CLR") | (starts("R") & ~starts("RANGE")), "Resistors")
        .when(starts("C"), "Capacitors")
        .when(starts("D"), "Diodes")
        .when(starts("Q"), "Transistors")
        .when(starts("SW"), "Switches")
        .when(starts("LED"), "Diodes")
        .when(starts("X", "Y"), "Crystals/Oscillators")
        .when(starts("J"), "Hardware/Misc")
        .when(starts("U", "IC", "OP", "TL"), "ICs")
        .otherwise("Unknown")
    )


def needs_socket(category: Column | str, upper_value: Column | str) -> Column:
    return (col(category) == "ICs") & ~contains_any(col(upper_value), NO_SOCKET)


def with_class(df, ref: str = "ref", value: str = "val_raw"):
    """Adds ``category``, ``value`` and ``socket`` (whether a socket comes with the part).

    What several rules look at is a column of its own, so that it is computed once."""
    df = df.withColumns({"r_": strip(F.upper(col(ref))), "v_": strip(value)}).withColumn("u_", F.upper("v_"))
    df = df.withColumns({"category": _category(col("r_"), col("u_")), "n_": parse_value("v_", trimmed=True)})
    plain = F.when(col("category") == "Optoelectronics", col("v_")).otherwise(normalize("category", "v_", col("n_"), trimmed=True))
    df = df.withColumns({"value": F.when(F.col("category").isNotNull(), plain), "socket": F.coalesce(needs_socket("category", "u_"), F.lit(False))})
    return df.drop("r_", "v_", "u_", "n_")


SOCKET_CATEGORY, SOCKET_VALUE = SOCKET
