"""JSON lines and Parquet of mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan.operators.assemble import flat
from veldspan.schema import ROW, ROW_SCHEMA, TRIPLE

NESTED_SCHEMA = (
    "triple_id string, s_prefix string, s_id string, p string, o_prefix string, o_id string, evidence array<struct<ev_id: string, ev_type: string, justification: string, author: string, "
    "row_confidence: double, derived_from: array<string>, confidence: double, ms_id: string, explanation: string>>"
)


def read_jsonl(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Rows of nested mappings, a line each; lines that don't parse are left out, or raise if ``strict``."""
    reader = spark.read.schema(NESTED_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return flat(reader.json(path)).where(" AND ".join(f"{c} IS NOT NULL" for c in TRIPLE))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW_SCHEMA).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first that exists, by its ending: Parquet, JSON lines, SSSOM."""
    from veldspan.sources.sssom import read_sssom

    for path in paths:
        if not exists(spark, path):
            continue
        plain = path.removesuffix(".gz")
        if plain.endswith(".jsonl"):
            return read_jsonl(spark, path)
        if plain.endswith(".tsv"):
            return read_sssom(spark, path)[0]
        return read_parquet(spark, path)
    raise ValueError(f"none of these exist: {', '.join(paths)}")


def read_xrefs(spark: SparkSession, path: str, *, target: str | None = None, confidence: float | None = None) -> DataFrame:
    """Rows of pre-extracted ontology cross-references ``(s_prefix, s_id, p, o_prefix, o_id)`` as Parquet, of one object prefix if given."""
    from veldspan.sources.rows import to_rows

    df = spark.read.parquet(path)
    if target is not None:
        df = df.where(F.col("o_prefix") == target)
    return to_rows(df, (F.col("s_prefix"), F.col("s_id")), (F.col("o_prefix"), F.col("o_id")), predicate=F.col("p"), confidence=confidence, ms_id=path).select(*ROW)
