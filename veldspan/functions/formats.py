"""Small text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_prefix(column: str | Column, prefix: str) -> Column:
    """The text without a literal prefix, if it has it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def flag(condition: Column) -> Column:
    """``true`` or ``false`` as text; null is false."""
    return F.coalesce(condition, F.lit(False)).cast("string")


def short_number(n: str | Column) -> Column:
    """``950``, ``12K``, ``3.4M``: at most three significant digits and a unit."""
    c = (F.col(n) if isinstance(n, str) else n).cast("double")

    def unit(size: float, letter: str) -> Column:
        x = c / F.lit(size)
        digits = F.when(x < 10, F.round(x, 1).cast("string")).otherwise(F.round(x, 0).cast("long").cast("string"))
        return F.concat(F.regexp_replace(digits, r"\.0$", ""), F.lit(letter))

    return F.when(c < 1000, c.cast("long").cast("string")).when(c < 1e6, unit(1e3, "K")).otherwise(unit(1e6, "M"))
