"""Components of the mapping graph and their statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.components import component_numbers, connected_components
from veldspan.functions.refs import curie
from veldspan.registry import REGISTRY


def components(rows: DataFrame, *, named: bool = True) -> DataFrame:
    """``(prefix, id, component)`` of each concept; a component is named by its least CURIE, or if not ``named`` by some long."""
    edges = rows.select(curie("s_prefix", "s_id").alias("a"), curie("o_prefix", "o_id").alias("b"))
    parts = (connected_components if named else component_numbers)(edges, "a", "b")
    split = F.split("node", ":", 2)
    return parts.select(split[0].alias("prefix"), split[1].alias("id"), "component")


def aggregate_components(rows: DataFrame, prefixes: str | Iterable[str] | None = None) -> DataFrame:
    """``(prefixes, component)`` of each component, its prefixes sorted.

    With an allow-list only concepts of those prefixes count.  Components with the
    same members left are one; that concerns those with none, which become a single
    component without prefixes.
    """
    parts = components(rows)
    if prefixes is None:
        return parts.groupBy("component").agg(F.array_sort(F.collect_set("prefix")).alias("prefixes")).select("prefixes", "component")
    allowed = F.col("prefix").isin(REGISTRY.normalize_all(prefixes))
    own = parts.groupBy("component").agg(F.array_sort(F.collect_set(F.when(allowed, F.col("prefix")))).alias("prefixes"))
    none = F.size("prefixes") == 0
    return own.select("prefixes", F.when(~none, F.col("component")).alias("component")).distinct()


def component_sizes(rows: DataFrame, prefixes: str | Iterable[str] | None = None) -> DataFrame:
    """``(prefixes, n)``: components by their set of prefixes.

    With an allow-list of up to 63 prefixes a component's set is one long with a bit for each.
    """
    allowed = None if prefixes is None else sorted(REGISTRY.normalize_all(prefixes))
    if allowed is None or len(allowed) > 63:
        return aggregate_components(rows, prefixes).groupBy("prefixes").agg(F.count("*").alias("n"))
    bit = F.lit(0).cast("long")
    for k, prefix in enumerate(allowed):
        bit = F.when(F.col("prefix") == prefix, F.lit(1 << k).cast("long")).otherwise(bit)
    own = components(rows, named=False).groupBy("component").agg(F.bit_or(bit).alias("bits"))
    sizes = own.groupBy("bits").agg(F.count("*").alias("n"))
    named = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0, prefix) for k, prefix in enumerate(allowed))))
    named = F.when(F.col("bits") == 0, F.array().cast("array<string>")).otherwise(named)
    # components without any member left are one
    return sizes.select(named.alias("prefixes"), F.when(F.col("bits") == 0, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"))


def coverage_of(sizes: DataFrame) -> DataFrame:
    """``(n_prefixes, n)`` of ``(prefixes, n)``, with zeros for sizes between 1 and the greatest."""
    by = sizes.groupBy(F.size("prefixes").alias("n_prefixes")).agg(F.sum("n").alias("n"))
    fill = by.agg(F.max("n_prefixes").alias("most")).where("most >= 1").select(F.explode(F.sequence(F.lit(1), "most")).alias("n_prefixes"), F.lit(0).cast("long").alias("n"))
    return by.unionByName(fill).groupBy("n_prefixes").agg(F.sum("n").alias("n"))


def coverage_sizes(rows: DataFrame, prefixes: str | Iterable[str] | None = None) -> DataFrame:
    return coverage_of(component_sizes(rows, prefixes))
