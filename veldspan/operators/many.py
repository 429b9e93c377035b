"""Many-to-many mappings between two vocabularies, and projection to one-to-one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.operators.assemble import assemble
from veldspan.operators.filters import keep_object_prefixes, keep_subject_prefixes

PAIR = ["s_prefix", "s_id", "o_prefix", "o_id"]


def _crowded(rows: DataFrame) -> DataFrame:
    """Distinct pairs whose subject has several objects of that prefix, or whose object several subjects."""
    pairs = rows.select(*PAIR).distinct()
    by_subject = ["s_prefix", "o_prefix", "s_id"]
    by_object = ["s_prefix", "o_prefix", "o_id"]
    subjects = pairs.groupBy(*by_subject).agg(F.count("*").alias("n")).where("n > 1").select(*by_subject, F.lit(True).alias("many_s"))
    objects = pairs.groupBy(*by_object).agg(F.count("*").alias("n")).where("n > 1").select(*by_object, F.lit(True).alias("many_o"))
    return pairs.join(subjects, by_subject, "left").join(objects, by_object, "left").where("many_s OR many_o").select(*PAIR)


def many_to_many(rows: DataFrame) -> DataFrame:
    """Assembled rows of many-to-many pairs, by any predicate."""
    return assemble(rows.join(_crowded(rows), PAIR, "left_semi"))


def drop_many_to_many(rows: DataFrame) -> DataFrame:
    return rows.join(_crowded(rows), PAIR, "left_anti")


def project(rows: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Assembled one-to-one rows from ``source`` to ``target``, and those that weren't."""
    own = keep_object_prefixes(keep_subject_prefixes(rows, source), target)
    return assemble(drop_many_to_many(own)), many_to_many(own)


def project_dict(rows: DataFrame, source: str, target: str) -> dict[str, str]:
    """Identifier to identifier, on the driver: for edges of a program, at a vocabulary's size."""
    pairs = project(rows, source, target)[0].select("s_id", "o_id").distinct()
    return dict(map(tuple, pairs.collect()))
