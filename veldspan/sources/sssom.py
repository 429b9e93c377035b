"""SSSOM tables, plain or gzipped, with their commented header."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan.functions.refs import identifier_of, prefix_of
from veldspan.registry import REGISTRY, Registry
from veldspan.schema import MAPPING_SETS_SCHEMA, ROW
from veldspan.sources.files import exists
from veldspan.sources.rows import to_rows

#: Lines that a header may have; it is read by the driver.  A table whose header is longer isn't found, which raises.
HEADER_LINES = 10_000
FIELDS = (
    "subject_id", "predicate_id", "object_id", "mapping_justification", "confidence", "author_id", "mapping_source", "mapping_provider", "license", "comment", "derived_from",
)


def read_header(spark: SparkSession, path: str) -> dict:
    """``{"curie_map": {...}, key: value}`` of the leading ``#`` lines, and ``columns``."""
    out: dict = {"curie_map": {}}
    section = None
    for (line,) in spark.read.text(path).limit(HEADER_LINES).collect():
        if not line.startswith("#"):
            out["columns"] = line.split("\t")
            break
        body = line[1:]
        m = re.match(r"^(\s*)([^:]+):\s*(.*)$", body)
        if not m:
            continue
        indent, key, value = m.groups()
        value = value.strip().strip("'\"")
        if indent and section == "curie_map":
            out["curie_map"][key.strip()] = value
        elif not indent:
            section = key.strip()
            if value:
                out[section] = value
    return out


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """All columns as text, and the header."""
    parts = exists(spark, f"{path}/rows")  # a folder as it is written in parallel
    head = read_header(spark, f"{path}/header" if parts else path)
    if "columns" not in head:
        raise ValueError(f"no table in {path}")
    schema = ", ".join(f"`{c}` string" for c in head["columns"])
    dealt = not parts and path.endswith(".gz")
    reader = spark.read.schema(schema).option("sep", "\t").option("header", str(not parts and not dealt).lower()).option("comment", "#").option("enforceSchema", "true").option("quote", "").option("mode", "PERMISSIVE")
    if dealt:  # one task has to unpack it; lines are dealt out before they are parsed
        lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != "\t".join(head["columns"]))).repartition("value")
        return DataFrame(reader._jreader.csv(getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())), spark), head
    return reader.csv(f"{path}/rows" if parts else path), head


def _reference_ok(column: str, registry: Registry) -> F.Column:
    return registry.canonical_column(prefix_of(column)).isNotNull() & identifier_of(column).isNotNull()


def read_sssom(spark: SparkSession, path: str, *, strict: bool = False, ms_id: str | None = None, set_confidence: float | None = None, registry: Registry = REGISTRY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, sets, rejected)``.

    A row's own source, else its provider, names its mapping set; the header's set
    otherwise, whose confidence holds for rows that have none.  Rows without valid
    references, predicate or justification are rejected, or raise if ``strict``.
    """
    table, head = read_table(spark, path)
    missing = [c for c in FIELDS if c not in table.columns]
    table = table.withColumns({c: F.lit(None).cast("string") for c in missing})
    set_id = ms_id or head.get("mapping_set_id") or path
    if set_confidence is None and "mapping_set_confidence" in head:
        set_confidence = float(head["mapping_set_confidence"])
    good = _reference_ok("subject_id", registry) & _reference_ok("object_id", registry) & prefix_of("predicate_id").isNotNull() & prefix_of("mapping_justification").isNotNull()
    good = F.coalesce(good & (F.col("confidence").isNull() | F.col("confidence").try_cast("double").between(0, 1)), F.lit(False))
    rejected = table.where(~good)
    if strict and (bad := rejected.limit(1).collect()):
        raise ValueError(f"invalid row in {path}: {bad[0]}")
    own = F.coalesce("mapping_source", "mapping_provider")
    of_set = F.lit(set_confidence).cast("double")
    rows = to_rows(
        table.where(good), (prefix_of("subject_id"), identifier_of("subject_id")), (prefix_of("object_id"), identifier_of("object_id")), predicate=_lower_prefix("predicate_id"),
        justification=F.col("mapping_justification"), confidence=F.col("confidence").try_cast("double"), set_confidence=F.when(own.isNull(), of_set),
        author=F.nullif(F.regexp_replace(F.split("author_id", r"\|")[0], "^orcid:", ""), F.lit("")), ms_id=F.coalesce(own, F.lit(set_id)), validate=False, registry=registry,
    )
    line = (set_id, head.get("mapping_set_title"), head.get("license"), head.get("mapping_set_version"), set_confidence, head.get("mapping_set_source"))
    sets = spark.createDataFrame([line], MAPPING_SETS_SCHEMA)
    named = table.where(good & own.isNotNull()).select(own.alias("ms_id"), "license").groupBy("ms_id").agg(F.max("license").alias("license"))
    none = F.lit(None).cast("string")
    sets = sets.unionByName(named.select("ms_id", none.alias("title"), "license", none.alias("version"), F.lit(None).cast("double").alias("confidence"), F.col("ms_id").alias("source")))
    return rows.select(*ROW), sets, rejected


def _lower_prefix(column: str) -> F.Column:
    return F.concat(F.lower(prefix_of(column)), F.lit(":"), identifier_of(column))
