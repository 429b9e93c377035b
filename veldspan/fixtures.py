"""A mapping table derived from the driver's ``lineitem``, and its companions.

One line item is one evidence row; clusters of four orders are small components with
five prefixes, all kinds of predicates, many-to-many pairs and null confidences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan.functions.refs import curie
from veldspan.schema import MAPPING_SETS_SCHEMA, ROW, TRIPLE
from veldspan.workspace import literal

PRIORITY = ["mesh", "doid", "efo", "umls"]
NEGATIVE = "l_quantity = 50"

_COLUMNS = {
    "s_prefix": "element_at(array('doid', 'mesh', 'umls', 'efo'), CAST(1 + l_linenumber % 4 AS INT))",
    "s_id": "concat(CAST(l_orderkey DIV 4 AS STRING), '-', CAST(l_suppkey % 2 AS STRING))",
    "p": """CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'skos:exactMatch' WHEN 'RF' THEN 'skos:exactMatch'
        WHEN 'NO' THEN 'oboinowl:hasDbXref' WHEN 'AO' THEN 'skos:broadMatch' WHEN 'NF' THEN 'skos:narrowMatch' ELSE 'skos:closeMatch' END""",
    "o_prefix": "element_at(array('doid', 'mesh', 'umls', 'efo', 'ncit'), CAST(1 + l_partkey % 5 AS INT))",
    "o_id": "concat(CAST(l_orderkey DIV 4 AS STRING), '-', CAST(l_partkey % 2 AS STRING))",
    "ev_type": "'simple'",
    "justification": """CASE l_linenumber % 3 WHEN 0 THEN 'semapv:ManualMappingCuration' WHEN 1 THEN 'semapv:LexicalMatching'
        ELSE 'semapv:UnspecifiedMatching' END""",
    "author": "CAST(CAST(l_suppkey % 7 AS INT) AS STRING)",
    "row_confidence": "CASE WHEN l_tax > 0 THEN 1 - l_discount END",
    "derived_from": "CAST(NULL AS ARRAY<STRING>)",
    "confidence": "coalesce(CASE WHEN l_tax > 0 THEN 1 - l_discount END, CASE WHEN l_linestatus = 'O' THEN 0.9D END)",
    "ms_id": "concat('set-', l_linestatus)",
    "explanation": "CAST(NULL AS STRING)",
}


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def rows(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return lineitem(spark, sf_dir).where(where).select(*(F.expr(_COLUMNS[c]).alias(c) for c in ROW))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that are known to be wrong."""
    return rows(spark, sf_dir, NEGATIVE).select(*TRIPLE).distinct()


def mapping_sets(spark: SparkSession) -> DataFrame:
    data = [("set-F", "F-set", None, None, None, "mesh"), ("set-O", "O-set", "https://creativecommons.org/publicdomain/zero/1.0/", "1", 0.9, "doid")]
    return literal(spark, data, MAPPING_SETS_SCHEMA)


def exact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full term lists of doid, mesh and umls: those of the mappings' subjects, and some that no mapping has."""
    own = rows(spark, sf_dir).where("s_prefix IN ('doid', 'mesh', 'umls')").select(F.col("s_prefix").alias("prefix"), F.col("s_id").alias("id"))
    extra = lineitem(spark, sf_dir).select(F.lit("doid").alias("prefix"), F.expr("concat(CAST(l_orderkey DIV 4 AS STRING), '-2')").alias("id"))
    return own.unionByName(extra).distinct()


def subset_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of subsets of doid and mesh: the clusters of even number."""
    own = rows(spark, sf_dir).where("s_prefix IN ('doid', 'mesh')").select(F.col("s_prefix").alias("prefix"), F.col("s_id").alias("id"))
    return own.where("CAST(split(id, '-')[0] AS BIGINT) % 2 = 0").distinct()


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is-a edges supplier and customer to nation to region."""
    edge = "child_prefix", "child_id", "parent_prefix", "parent_id"

    def edges(table: str, child: str, key: str, parent: str, parent_key: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(F.lit(child).alias(edge[0]), F.col(key).cast("string").alias(edge[1]), F.lit(parent).alias(edge[2]), F.col(parent_key).cast("string").alias(edge[3]))

    out = edges("supplier", "supplier", "s_suppkey", "nation", "s_nationkey")
    out = out.unionByName(edges("customer", "customer", "c_custkey", "nation", "c_nationkey"))
    return out.unionByName(edges("nation", "nation", "n_nationkey", "region", "n_regionkey"))


def lookup_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a CURIE to remap; some can't be parsed and some are not canonical."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = """CASE o_orderkey % 11 WHEN 0 THEN 'no reference' WHEN 1 THEN concat('DO:', CAST(o_orderkey DIV 4 AS STRING), '-0')
        ELSE concat('doid:', CAST(o_orderkey DIV 4 AS STRING), '-', CAST(o_custkey % 2 AS STRING)) END"""
    return df.select("o_orderkey", F.expr(text).alias("curie"))


def lexical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select(
        F.col("p_name").alias("text"), F.lower("p_name").alias("norm_text"), F.when(F.col("p_partkey") % 2 == 0, "doid").otherwise("umls").alias("db"),
        F.expr("concat(CAST(p_partkey DIV 2 AS STRING), '-', CAST(p_partkey % 2 AS STRING))").alias("id"), F.col("p_name").alias("entry_name"),
        F.when(F.col("p_partkey") % 3 == 0, "name").otherwise("synonym").alias("status"), F.lit("parts").alias("source"),
        *(F.lit(None).cast("string").alias(c) for c in ("organism", "source_db", "source_id")),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the concepts with an identifier on ``-0``."""
    ends = rows(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("s_prefix").alias("prefix"), F.col("s_id").alias("id")), F.struct(F.col("o_prefix").alias("prefix"), F.col("o_id").alias("id")))).alias("r"))
    return ends.select("r.*").where("id LIKE '%-0'").distinct().select("prefix", "id", F.concat(F.lit("concept "), curie("prefix", "id")).alias("name"))
