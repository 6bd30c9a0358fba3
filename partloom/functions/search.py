"""Supplier search terms and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .knowledge import PEDALPCB, TAPERS, TAYDA
from .text import col, strip
from .units import parse_value, search_string


def bare_pot(value: Column | str) -> Column:
    """A potentiometer's value without taper letters, dashes and spaces."""
    return F.regexp_replace(F.upper(col(value)), rf"(?U)[{''.join(TAPERS)}\-\s]", "")


def search_term(category: Column | str, value: Column | str, spec: Column | str, bare: Column | None = None, number: Column | None = None) -> Column:
    """``bare`` and ``number``: bare_pot() of the value and what it parses to, where they are at hand as columns."""
    cat, v, spec = col(category), col(value), col(spec)
    farad = F.when(v.rlike("[pnu]$"), F.concat(v, F.lit("F"))).otherwise(v)
    cap = F.when(spec == "MLCC", F.concat(farad, F.lit(" multilayer"))).when(spec != "", F.concat_ws(" ", farad, spec)).otherwise(farad)
    up = F.upper(v)
    taper = F.lit("Linear")
    for code in reversed(TAPERS):
        taper = F.when(F.contains(up, F.lit(code)), F.lit(TAPERS[code])).otherwise(taper)
    bare = bare_pot(value) if bare is None else bare
    number = parse_value(bare) if number is None else number
    size = F.when(number.isNotNull(), search_string(number)).when(bare != "", bare).otherwise(v)
    pot = F.concat(F.when(up.rlike("DUAL|STEREO"), "Dual Gang ").otherwise(""), size, F.lit(" ohm "), taper, F.lit(" potentiometer"))
    return (
        F.when(cat == "Resistors", F.concat(v, F.lit(" ohm 1/4w metal film")))
        .when(cat == "Capacitors", cap)
        .when(cat == "Potentiometers", pot)
        .when(cat == "Diodes", F.when(up == "LED", "LED 3mm").otherwise(v))
        .when(v == "8 PIN DIP SOCKET", "8 pin DIP IC Socket Adaptor Solder Type")
        .when(F.contains(up, F.lit("JRC4558")), "NJM4558D")
        .otherwise(v)
    )


def quoted(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def tayda_url(term: Column | str) -> Column:
    t = col(term)
    return F.when(t == "", "").otherwise(F.concat(F.lit(TAYDA), quoted(t)))


def pedalpcb_url(term: Column | str) -> Column:
    t = col(term)
    bare = strip(F.replace(t, F.lit(" PCB"), F.lit("")))
    return F.when(t == "", "").otherwise(F.concat(F.lit(PEDALPCB[0]), quoted(bare), F.lit(PEDALPCB[1])))
