"""SSSOM tables: one line for each evidence of each mapping, under a commented header."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.functions.confidence import rounded
from veldspan.functions.refs import curie, evidence_id
from veldspan.graph import author_curie
from veldspan.registry import REGISTRY, Registry
from veldspan.schema import CC0
from veldspan.workspace import Workspace, remove

COLUMNS = (
    "record_id", "subject_id", "subject_label", "predicate_id", "object_id", "object_label", "mapping_justification", "confidence", "license", "author_id", "comment", "derived_from",
)
#: Labels of these prefixes are never looked up.
UNLABELLED = ("omim", "pubchem.compound", "umls", "wikidata")


def with_labels(df: DataFrame, labels: DataFrame, skip: tuple[str, ...] = UNLABELLED) -> DataFrame:
    """Adds ``subject_label`` and ``object_label`` from ``labels (prefix, id, name)``."""
    own = labels.where(~F.col("prefix").isin(*skip)).groupBy("prefix", "id").agg(F.min("name").alias("name"))
    for side, c in (("s", "subject_label"), ("o", "object_label")):
        df = df.join(own.select(F.col("prefix").alias(f"{side}_prefix"), F.col("id").alias(f"{side}_id"), F.col("name").alias(c)), [f"{side}_prefix", f"{side}_id"], "left")
    return df


def sssom_rows(rows: DataFrame, labels: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """The exchange form of rows, all columns text but the confidence."""
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"subject_label": none, "object_label": none}) if labels is None else with_labels(rows, labels)
    rows = rows.withColumn("license", none) if sets is None else rows.join(sets.select("ms_id", "license"), "ms_id", "left")
    reasoned = F.col("ev_type") == "reasoned"
    return rows.select(
        evidence_id().alias("record_id"), curie("s_prefix", "s_id").alias("subject_id"), "subject_label", F.col("p").alias("predicate_id"), curie("o_prefix", "o_id").alias("object_id"),
        "object_label", F.col("justification").alias("mapping_justification"), rounded("row_confidence").alias("confidence"),
        F.when(reasoned, F.lit(CC0)).otherwise(F.col("license")).alias("license"), F.when(F.col("author").isNotNull(), author_curie()).alias("author_id"), F.col("explanation").alias("comment"),
        F.array_join("derived_from", "|").alias("derived_from"),
    )


def _header(table: DataFrame, set_id: str, registry: Registry) -> list[str]:
    """``#curie_map`` of the prefixes that occur, few, and the set's id."""
    ids = F.array("subject_id", "predicate_id", "object_id", "mapping_justification", "author_id", F.regexp_extract("derived_from", "^[^|]*", 0))
    used = table.select(F.explode(ids).alias("c")).select(F.regexp_extract("c", "^([^:]+):", 1).alias("p")).where("p <> ''").distinct()
    prefixes = sorted(r.p for r in used.collect())
    return ["#curie_map:", *(f"#  {p}: {registry.by_prefix[p].uri}" for p in prefixes if p in registry.by_prefix), f"#mapping_set_id: {set_id}"]


def used_columns(table: DataFrame) -> list[str]:
    """Columns that have a value anywhere; one aggregate over the table."""
    seen = table.agg(*(F.max(F.coalesce(F.col(c).cast("string") != "", F.lit(False))).alias(c) for c in table.columns)).first()
    return [c for c in table.columns if seen[c]]


def write_sssom(rows: DataFrame, path: str, *, set_id: str, labels: DataFrame | None = None, sets: DataFrame | None = None, prune: bool = True, single_file: bool = True, compress: bool = False, registry: Registry = REGISTRY) -> None:
    """Write a table with header.

    ``prune`` leaves out empty columns.  ``single_file`` gives one file at
    ``path`` (sorted, through the driver; for exchange); otherwise ``path`` becomes
    a folder of headerless ``rows``, unsorted, and a ``header``, written in parallel.
    Readers take both.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "sssom")
    table = ws.save(sssom_rows(rows, labels, sets), "table")
    columns = used_columns(table) if prune else list(COLUMNS)
    head = [*_header(table, set_id, registry), "\t".join(columns)]
    text = F.concat_ws("\t", *(F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " "), F.lit("")) for c in columns))
    if single_file:
        at = f"{ws.path}/lines"
        ordered = table.orderBy("subject_id", "predicate_id", "object_id", "record_id").select(text.alias("value"))
        ordered.write.option("compression", "gzip").text(at)
        _join(spark, head, at, path, compress)
    else:
        table.select(text.alias("value")).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(f"{path}/rows")
        spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    ws.drop()


def _join(spark, head: list[str], parts: str, path: str, compress: bool) -> None:
    """Head and part files into one file, copied stream by stream through Hadoop's file systems.

    Parts are gzipped by those who wrote them, and a file of several members is one gzip file; without ``compress`` they are unpacked.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    first = ("\n".join(head) + "\n").encode()
    out.write(bytearray(gzip.compress(first) if compress else first))
    fs = source.getFileSystem(conf)
    for name in sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")):
        with_in = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        if not compress:
            with_in = jvm.java.util.zip.GZIPInputStream(with_in, 1 << 16)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(with_in, out, 1 << 16, False)
        with_in.close()
    out.close()
    remove(spark, parts)
