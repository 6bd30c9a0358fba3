"""Values with unit prefixes: parsing, search and display forms, capacitor kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .knowledge import SI
from .text import col, strip

_UNITS = "pnuµmkKMG"


def _multiplier(unit: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SI.items() for x in kv]), unit), F.lit(1.0))


def parse_value(value: Column | str, trimmed: bool = False) -> Column:
    """``4k7`` -> 4700.0, ``100nF 63V`` -> 1e-7; null if the text does not begin with a number.

    ``trimmed``: the text has no white space around it, so it need not be looked for."""
    s = col(value) if trimmed else strip(value)
    sandwich = f"^([0-9]+)([{_UNITS}])([0-9]+)"
    plain = f"(?U)^([0-9.]+)\\s*([{_UNITS}])?"
    part = lambda p, i: F.regexp_extract(s, p, i)
    inner = F.concat(part(sandwich, 1), F.lit("."), part(sandwich, 3)).try_cast("double") * _multiplier(part(sandwich, 2))
    outer = part(plain, 1).try_cast("double") * _multiplier(part(plain, 2))
    return F.when(s.rlike(sandwich), inner).otherwise(outer)


def _whole(x: Column) -> Column:
    return x.cast("decimal(38,0)").cast("string")


def search_string(number: Column | str) -> Column:
    """4700.0 -> ``4.7k``; empty for null. One decimal at most with a prefix."""
    v = col(number)
    unit, size = F.when(v >= 1e6, "M").when(v >= 1e3, "k"), F.when(v >= 1e6, SI["M"]).when(v >= 1e3, SI["k"])
    for u in ("u", "n", "p"):
        fits = (v < 1.0) & (v >= SI[u])
        unit, size = unit.when(fits, u), size.when(fits, SI[u])
    unit, r = unit.otherwise(""), F.round(v / size.otherwise(1.0), 6)
    decimal = F.regexp_replace(F.call_function("format_number", r, F.lit("0.0")), ",", "")
    text = F.when(r == F.floor(r), r.cast("decimal(38,0)").cast("string")).when(unit == "", r.cast("string")).otherwise(decimal)
    return F.when(v.isNull(), "").otherwise(F.concat(text, unit))


def display_string(number: Column | str) -> Column:
    """4700.0 -> ``4k7``."""
    return F.regexp_replace(search_string(number), r"^([^.]*)\.(\d+)([a-zA-Z]+).*$", "$1$3$2")


def normalize(category: Column | str, value: Column | str, number: Column | None = None, trimmed: bool = False) -> Column:
    """Resistor and capacitor values in search form, unless they give a size in mm; others trimmed.

    ``number``: the parsed value where it is at hand as a column; the same for the functions below."""
    v = col(value) if trimmed else strip(value)
    number = parse_value(v, trimmed=True) if number is None else number
    electric = col(category).isin("Resistors", "Capacitors") & ~F.contains(F.lower(v), F.lit("mm"))
    return F.when(electric & number.isNotNull(), search_string(number)).otherwise(v)


def spec_type(category: Column | str, value: Column | str, number: Column | None = None) -> Column:
    """Kind of capacitor by capacitance; empty for all else."""
    f = parse_value(value) if number is None else number
    kind = F.when(f < 1e-9, "MLCC").when((f < 1e-6) | (F.abs(f - 1e-6) < 1e-9), "Box Film").otherwise("Electrolytic")
    return F.when((col(category) == "Capacitors") & f.isNotNull(), kind).otherwise("")


def bulky(value: Column | str) -> Column:
    """Whether a capacitor's text tells of micro-farads."""
    return F.contains(col(value), F.lit("u")) | F.contains(col(value), F.lit("µ"))
