"""The algebra of confidences: noisy-OR over independent evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspan.schema import PRECISION


def noisy_or(confidence: str | Column) -> Column:
    """Aggregate ``1 - product(1 - c)``; null and zero don't count, and none at all is null."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return 1 - F.product(F.when(c != 0, 1 - c))


def derived(confidence: str | Column, factor: float | Column = 1.0) -> Column:
    """Of what is derived from something of this confidence: ``1 - (1 - factor) (1 - c)``, null if c is null or zero."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    f = F.lit(factor) if isinstance(factor, float) else factor
    return F.when(c != 0, 1 - (1 - f) * (1 - c))


def rounded(confidence: str | Column) -> Column:
    return F.round(F.col(confidence) if isinstance(confidence, str) else confidence, PRECISION)


def text(confidence: str | Column, missing: str = "") -> Column:
    """As exports have it: rounded, ``missing`` where null or zero."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c != 0, F.round(c, PRECISION).cast("string")).otherwise(F.lit(missing))
