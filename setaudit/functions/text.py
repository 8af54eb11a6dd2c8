"""White space and number helpers on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character with the Unicode White_Space property (Java's (?U)\s).
SPACE = r"(?U)\s+"


def squeeze(c: Column | str) -> Column:
    """Trimmed, with each run of Unicode white space as one blank. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, SPACE, " "))


def blank_to_null(c: Column | str) -> Column:
    """Null where the text is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def numbers_in(c: Column | str) -> Column:
    """The numbers written in a text from left to right, as an array that compares in their order.

    Null and a text without digits give an empty array, which sorts first. Digits beyond 38 places are compared as
    their first 38, which no version string reaches.
    """
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), F.lit(1))
    return F.transform(digits, lambda d: F.substring(d, 1, 38).cast("decimal(38,0)"))
