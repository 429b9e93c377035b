"""Small fixtures: references of several prefixes and rows between them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veldspan.schema import BROAD, DB_XREF, EXACT, NARROW, ROW_SCHEMA, TRIPLE, UNSPECIFIED

A, B, C, D = "go", "mondo", "hp", "obi"


def ref(prefix: str, n: int) -> str:
    return f"{prefix}:{n:07d}"


def row(s: str, p: str, o: str, confidence: float | None = 0.95, *, justification: str = UNSPECIFIED, author: str | None = None, ms_id: str = "test") -> tuple:
    return (*s.split(":", 1), p, *o.split(":", 1), "simple", justification, author, confidence, None, confidence, ms_id, None)


def rows(spark, *data: tuple) -> DataFrame:
    return spark.createDataFrame(list(data), ROW_SCHEMA)


def line(spark, *steps: str) -> DataFrame:
    """Rows of a path: reference, predicate, reference, ..."""
    return rows(spark, *(row(steps[i], steps[i + 1], steps[i + 2]) for i in range(0, len(steps) - 2, 2)))


def triples(df: DataFrame) -> set[tuple[str, str, str]]:
    return {(f"{r.s_prefix}:{r.s_id}", r.p, f"{r.o_prefix}:{r.o_id}") for r in df.select(*TRIPLE).collect()}
