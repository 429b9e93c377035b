"""Building rows from columns, common to all readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspan.registry import REGISTRY, Registry
from veldspan.schema import EXACT, ROW, UNSPECIFIED


def _col(x: str | Column | None, kind: str = "string") -> Column:
    if x is None:
        return F.lit(None).cast(kind)
    return F.lit(x) if isinstance(x, str | float | int) else x


def to_rows(
    df: DataFrame, subject: tuple[str | Column, Column], obj: tuple[str | Column, Column], *, predicate: str | Column = EXACT, justification: str | Column = UNSPECIFIED,
    confidence: float | Column | None = None, set_confidence: Column | None = None, author: str | Column | None = None, ms_id: str | Column | None = None,
    validate: bool = True, registry: Registry = REGISTRY,
) -> DataFrame:
    """Simple rows of a table.

    Prefixes are literals or columns and are normalised; rows of unknown prefix
    or without an identifier are left out, and if ``validate`` those whose object
    isn't of its prefix's pattern.
    """
    own = _col(confidence, "double").cast("double")
    columns = {
        "s_prefix": registry.canonical_column(_col(subject[0])), "s_id": F.trim(subject[1].cast("string")), "p": _col(predicate),
        "o_prefix": registry.canonical_column(_col(obj[0])), "o_id": F.trim(obj[1].cast("string")), "ev_type": F.lit("simple"), "justification": _col(justification),
        "author": _col(author), "row_confidence": own, "derived_from": F.lit(None).cast("array<string>"),
        "confidence": own if set_confidence is None else F.coalesce(own, set_confidence), "ms_id": _col(ms_id), "explanation": F.lit(None).cast("string"),
    }
    rows = df.select(*(columns[c].alias(c) for c in ROW))
    rows = rows.where("s_prefix IS NOT NULL AND o_prefix IS NOT NULL AND s_id <> '' AND o_id <> ''")
    if validate:
        rows = rows.where(F.coalesce(F.rlike("o_id", registry.pattern_column(F.col("o_prefix"))), F.lit(True)))
    return rows
