"""Row-local filters, and filters by membership.

Prefix filters are plain predicates, so they reach the scan.  Filters by a table of
triples or terms are semi and anti joins; the planner broadcasts the table while its
measured size allows and shuffles both sides beyond that.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspan.functions.confidence import noisy_or
from veldspan.registry import REGISTRY, Registry
from veldspan.schema import IMPRECISE, TRIPLE


def keep_prefixes(rows: DataFrame, prefixes: str | Iterable[str]) -> DataFrame:
    """Both ends have one of the prefixes."""
    known = REGISTRY.normalize_all(prefixes)
    return rows.where(F.col("s_prefix").isin(known) & F.col("o_prefix").isin(known))


def keep_subject_prefixes(rows: DataFrame, prefixes: str | Iterable[str]) -> DataFrame:
    return rows.where(F.col("s_prefix").isin(REGISTRY.normalize_all(prefixes)))


def keep_object_prefixes(rows: DataFrame, prefixes: str | Iterable[str]) -> DataFrame:
    return rows.where(F.col("o_prefix").isin(REGISTRY.normalize_all(prefixes)))


def drop_prefixes(rows: DataFrame, prefixes: str | Iterable[str]) -> DataFrame:
    """Neither end has one of the prefixes."""
    known = REGISTRY.normalize_all(prefixes)
    return rows.where(~F.col("s_prefix").isin(known) & ~F.col("o_prefix").isin(known))


def drop_self_matches(rows: DataFrame) -> DataFrame:
    """Ends of one prefix go."""
    return rows.where("s_prefix <> o_prefix")


def drop_imprecise(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("p").isin(*IMPRECISE))


def with_predicates(rows: DataFrame, predicates: Iterable[str]) -> DataFrame:
    return rows.where(F.col("p").isin(*predicates))


def minimum_confidence(rows: DataFrame, cutoff: float = 0.7, assembled: bool = False) -> DataFrame:
    """Rows of at least this confidence; null goes.

    If ``assembled``, it is the whole mapping's confidence that counts, and all
    rows of the mapping stay or go.
    """
    if not assembled:
        return rows.where(F.col("confidence") >= cutoff)
    good = rows.groupBy(*TRIPLE).agg(noisy_or("confidence").alias("c")).where(F.col("c") >= cutoff).select(*TRIPLE)
    return rows.join(good, TRIPLE, "left_semi")


def drop_triples(rows: DataFrame, triples: DataFrame, symmetric: bool = False) -> DataFrame:
    """Rows whose triple is in ``triples`` go, in that direction only unless ``symmetric``."""
    skip = triples.select(*TRIPLE)
    if symmetric:
        skip = skip.unionByName(skip.select(F.col("o_prefix").alias("s_prefix"), F.col("o_id").alias("s_id"), "p", F.col("s_prefix").alias("o_prefix"), F.col("s_id").alias("o_id")))
    own, skip = (df.withColumn("_hash", F.xxhash64(*TRIPLE)) for df in (rows, skip.distinct()))  # decides nearly all comparisons of a sort
    return own.join(skip, ["_hash", *TRIPLE], "left_anti").select(*rows.columns)


def keep_subsets(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms (prefix, id)``: an end whose prefix occurs there must itself be there; other prefixes pass.

    The prefixes that occur are few (they are vocabularies), so they are one small join.
    """
    terms = terms.select("prefix", "id").distinct()
    limited = terms.select("prefix").distinct()
    for side in ("s", "o"):
        member = terms.select(F.col("prefix").alias(f"{side}_prefix"), F.col("id").alias(f"{side}_id"), F.lit(True).alias("_member"))
        known = limited.select(F.col("prefix").alias(f"{side}_prefix"), F.lit(True).alias("_limited"))
        rows = rows.join(member, [f"{side}_prefix", f"{side}_id"], "left").join(known, f"{side}_prefix", "left")
        rows = rows.where("_limited IS NULL OR _member").drop("_member", "_limited")
    return rows


def mutation_applies(source: str, target: str | list[str] | None, old: str) -> Column:
    """Whether a mutation rule applies: subject prefix, predicate, and object prefix if limited."""
    out = (F.col("s_prefix") == source) & (F.col("p") == old)
    if target is None:
        return out
    return out & F.col("o_prefix").isin([target] if isinstance(target, str) else target)


def violations(rows: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Distinct invalid triples with a ``problem``: prefix not canonical, identifier off its pattern or with a colon."""
    problems = []
    for side, prefix, identifier in (("subject", "s_prefix", "s_id"), ("object", "o_prefix", "o_id")):
        canonical = registry.canonical_column(F.col(prefix))
        pattern = registry.pattern_column(F.col(prefix))
        problems += [
            F.when(canonical.isNull() | (canonical != F.col(prefix)), f"invalid {side} prefix"),
            F.when(F.contains(identifier, F.lit(":")), f"colon in {side}"),
            F.when(~F.rlike(F.col(identifier), pattern), f"invalid {side} identifier"),
        ]
    return rows.select(*TRIPLE, F.coalesce(*problems).alias("problem")).where("problem IS NOT NULL").distinct()


def validate(rows: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """``rows`` if all are valid; raises with the first violations otherwise."""
    if bad := violations(rows, registry).orderBy(*TRIPLE).limit(20).collect():
        raise ValueError("invalid mappings: " + "; ".join(f"{r.s_prefix}:{r.s_id} {r.p} {r.o_prefix}:{r.o_id} ({r.problem})" for r in bad))
    return rows
