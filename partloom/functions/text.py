"""Text expressions with the white space and line rules of the inputs: Unicode spaces, newline as the only line end."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters that Unicode and Python count as white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def alternation(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike(alternation(words))


def starts_any(c: Column, words: list[str]) -> Column:
    return c.rlike(f"^(?:{alternation(words)})")


def has_digit(c: Column) -> Column:
    return c.rlike(r"(?U)\d")


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
