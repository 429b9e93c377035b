"""Counts over mappings: by vocabulary pair, by term, by source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.registry import REGISTRY
from veldspan.schema import TRIPLE


def source_target_counts(rows: DataFrame, minimum: int = 0) -> DataFrame:
    """``(s_prefix, o_prefix, n)``: distinct triples between vocabularies, those with more than ``minimum``."""
    return rows.select(*TRIPLE).distinct().groupBy("s_prefix", "o_prefix").agg(F.count("*").alias("n")).where(F.col("n") > minimum)


def source_target_table(rows: DataFrame, minimum: int = 0) -> str:
    """The counts as a Markdown table, most first.  One line for each pair of vocabularies."""
    lines = ["| source prefix | target prefix | count |", "|---|---|---|"]
    counts = source_target_counts(rows, minimum).orderBy(F.desc("n"), "s_prefix", "o_prefix").collect()
    return "\n".join(lines + [f"| {r.s_prefix} | {r.o_prefix} | {r.n} |" for r in counts])


def identifier_index(rows: DataFrame, predicates: Iterable[str] | None = None, directed: bool = False) -> DataFrame:
    """``(left_prefix, right_prefix, id)``: identifiers of the left vocabulary that are mapped to the right one."""
    if predicates is not None:
        rows = rows.where(F.col("p").isin(*predicates))
    out = rows.select(F.col("s_prefix").alias("left_prefix"), F.col("o_prefix").alias("right_prefix"), F.col("s_id").alias("id"))
    if not directed:
        out = out.unionByName(rows.select(F.col("o_prefix").alias("left_prefix"), F.col("s_prefix").alias("right_prefix"), F.col("o_id").alias("id")))
    return out.distinct()


def observed_terms(rows: DataFrame) -> DataFrame:
    """``(prefix, id)`` of both ends."""
    ends = rows.select(F.col("s_prefix").alias("prefix"), F.col("s_id").alias("id")).unionByName(rows.select(F.col("o_prefix").alias("prefix"), F.col("o_id").alias("id")))
    return ends.distinct()


def term_counts(prefixes: Iterable[str], exact: DataFrame, observed: DataFrame, spark=None) -> DataFrame:
    """``(prefix, exact, n)``: terms of the full list if there is one, else those observed, else none."""
    spark = spark or exact.sparkSession
    own = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    full = exact.groupBy("prefix").agg(F.countDistinct("id").alias("n_exact"))
    seen = observed.groupBy("prefix").agg(F.countDistinct("id").alias("n_observed"))
    out = own.join(full, "prefix", "left").join(seen, "prefix", "left")
    return out.select("prefix", (F.coalesce("n_exact", F.lit(0)) > 0).alias("exact"), F.coalesce("n_exact", "n_observed", F.lit(0)).cast("long").alias("n"))


def symmetric_counts(index: DataFrame, priority: list[str], exact: DataFrame, observed: DataFrame) -> DataFrame:
    """``(left_prefix, right_prefix, n)``: the greater of both sides' mapped terms; the diagonal has all terms.

    Where a vocabulary's full list is known, only its terms count.
    """
    listed = exact.select(F.col("prefix").alias("left_prefix")).distinct().withColumn("listed", F.lit(True))
    terms = exact.select(F.col("prefix").alias("left_prefix"), "id").distinct().withColumn("known", F.lit(True))
    own = index.join(terms, ["left_prefix", "id"], "left").join(listed, "left_prefix", "left")
    good = F.col("known") | F.col("listed").isNull()
    sizes = own.groupBy("left_prefix", "right_prefix").agg(F.count_if(good).alias("n"))
    back = sizes.select(F.col("right_prefix").alias("left_prefix"), F.col("left_prefix").alias("right_prefix"), F.col("n").alias("m"))
    pairs = sizes.join(back, ["left_prefix", "right_prefix"], "left")
    pairs = pairs.where((F.col("left_prefix") != F.col("right_prefix")) | ~F.col("left_prefix").isin(priority))
    pairs = pairs.select("left_prefix", "right_prefix", F.greatest("n", F.coalesce("m", F.lit(0))).alias("n"))
    diagonal = term_counts(priority, exact, observed).select(F.col("prefix").alias("left_prefix"), F.col("prefix").alias("right_prefix"), "n")
    return pairs.unionByName(diagonal)


def asymmetric_counts(index: DataFrame) -> DataFrame:
    """``(left_prefix, right_prefix, n)`` as directed."""
    return index.groupBy("left_prefix", "right_prefix").agg(F.count("*").alias("n"))


def pivot(counts: DataFrame, priority: list[str]) -> DataFrame:
    """A line for each prefix of ``priority`` and a column for each, no count as 0; lines without any go."""
    own = counts.where(F.col("left_prefix").isin(priority) & F.col("right_prefix").isin(priority))
    return own.groupBy("left_prefix").pivot("right_prefix", priority).agg(F.first("n")).fillna(0)


def gains(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """``(left_prefix, right_prefix, raw, processed, gain, percent)``; percent is null where there was none."""
    keys = ["left_prefix", "right_prefix"]
    both = raw.withColumnRenamed("n", "raw").join(processed.withColumnRenamed("n", "processed"), keys, "full").fillna(0, ["raw", "processed"])
    return both.select(*keys, "raw", "processed", (F.col("processed") - F.col("raw")).alias("gain"), F.round(100.0 * (F.col("processed") - F.col("raw")) / F.nullif("raw", F.lit(0)), 1).alias("percent"))


def unobserved(prefixes: Iterable[str], exact: DataFrame, observed: DataFrame) -> DataFrame:
    """``(prefix, n)``: listed terms that no mapping has; prefixes that no mapping has are left out, those without a list have 0."""
    prefixes = list(prefixes)
    seen = observed.where(F.col("prefix").isin(prefixes)).select("prefix").distinct()
    rest = exact.select("prefix", "id").distinct().join(observed.select("prefix", "id"), ["prefix", "id"], "left_anti")
    rest = rest.groupBy("prefix").agg(F.count("*").alias("n"))
    return seen.join(rest, "prefix", "left").fillna(0, ["n"])


def summarize_prefixes(rows: DataFrame) -> DataFrame:
    """Each prefix of the rows with its ``name, homepage, description``."""
    prefixes = rows.select(F.explode(F.array("s_prefix", "o_prefix")).alias("prefix")).distinct()
    return prefixes.join(REGISTRY.frame(rows.sparkSession), "prefix", "left").select("prefix", "name", "homepage", "description")


def by_source(rows: DataFrame) -> DataFrame:
    """``(ms_id, n)``: rows of each mapping set that has any."""
    return rows.where("ms_id IS NOT NULL").groupBy("ms_id").agg(F.count("*").alias("n"))


def tabulate(rows: DataFrame, limit: int | None = None) -> str:
    """All triples in order as a text table, a line for each evidence, repeated triples blank; the first ``limit`` lines if given.  For reading."""
    columns = [*TRIPLE, "justification", "confidence"]
    lines, before = ["subject | predicate | object | justification | confidence"], None
    ordered = rows.orderBy(*columns)
    for r in (ordered if limit is None else ordered.limit(limit)).toLocalIterator():
        triple = f"{r.s_prefix}:{r.s_id} | {r.p} | {r.o_prefix}:{r.o_id}"
        lines.append(f"{triple if triple != before else ' |  | '} | {r.justification} | {'' if r.confidence is None else r.confidence}")
        before = triple
    return "\n".join(lines)
