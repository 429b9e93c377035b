"""How vocabularies cover a domain: overlaps, unique concepts, reduction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.operators import counts
from veldspan.operators.components import component_sizes, coverage_of
from veldspan.registry import REGISTRY
from veldspan.schema import DB_XREF, EXACT, PRECISION
from veldspan.workspace import Workspace


def summary_frame(priority: list[str], exact: DataFrame, observed: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """``prefix, name, license, version, terms, status``: terms are ``observed``, a ``subset``, or the ``full`` list."""
    terms = counts.term_counts(priority, exact, observed)
    if subset is None:
        terms = terms.withColumn("subset", F.lit(False))
    else:
        limited = subset.select("prefix").distinct().withColumn("subset", F.lit(True))
        terms = terms.join(limited, "prefix", "left").fillna({"subset": False})
    status = F.when(~F.col("exact"), "observed").when(F.col("subset"), "subset").otherwise("full")
    return terms.join(REGISTRY.frame(exact.sparkSession), "prefix", "left").select("prefix", "name", "license", "version", F.col("n").alias("terms"), status.alias("status"))


def source_summary(frame: DataFrame) -> DataFrame:
    """One line: total terms, and how many vocabularies have none."""
    return frame.agg(F.coalesce(F.sum("terms"), F.lit(0)).alias("total_terms"), F.count_if(F.col("terms") == 0).alias("without_terms"))


@dataclass
class Overlaps:
    raw: DataFrame
    processed: DataFrame
    priority: DataFrame
    prefixes: list[str]

    @property
    def gains(self) -> DataFrame:
        return counts.gains(self.raw, self.processed)

    @property
    def number(self) -> int:
        """How many combinations of vocabularies there are."""
        return 2 ** len(self.prefixes) - 1


def overlaps(raw: DataFrame, processed: DataFrame, priority_rows: DataFrame, priority: list[str], exact: DataFrame, observed: DataFrame) -> Overlaps:
    """Overlap counts of raw and processed mappings (symmetric) and of the star graph (directed)."""

    def symmetric(rows: DataFrame) -> DataFrame:
        return counts.symmetric_counts(counts.identifier_index(rows, [EXACT, DB_XREF]), priority, exact, observed)

    stars = counts.asymmetric_counts(counts.identifier_index(priority_rows, [EXACT, DB_XREF], directed=True))
    return Overlaps(symmetric(raw), symmetric(processed), stars, priority)


@dataclass
class Landscape:
    """``mapped`` and ``single`` are ``(prefixes, n)``; ``total_terms`` has one line."""

    mapped: DataFrame
    single: DataFrame
    total_terms: DataFrame
    priority: list[str]

    def counter(self) -> DataFrame:
        """Concepts by their set of prefixes; sets without any are left out."""
        both = self.mapped.unionByName(self.single).groupBy("prefixes").agg(F.sum("n").alias("n"))
        return both.where("n > 0")

    def distribution(self) -> DataFrame:
        """``(n_prefixes, n)``, zeros filled in."""
        return coverage_of(self.counter())

    def summary(self) -> DataFrame:
        """One line: ``at_least_1, only_1, conserved, reduced, total, reduction``."""
        everything = F.array_sort(F.array(*map(F.lit, self.priority)))
        none = F.lit(0)
        mapped = self.mapped.agg(F.coalesce(F.sum("n"), none).alias("at_least_1"), F.coalesce(F.sum(F.when(F.col("prefixes") == everything, F.col("n"))), none).alias("conserved"))
        single = self.single.agg(F.coalesce(F.sum("n"), none).alias("only_1"))
        one = mapped.join(F.broadcast(single)).join(F.broadcast(self.total_terms))  # one line each
        reduced = F.col("at_least_1") + F.col("only_1")
        reduction = F.round((F.col("total") - reduced).cast("double") / F.nullif("total", none), PRECISION)
        return one.select("at_least_1", "only_1", "conserved", reduced.alias("reduced"), "total", reduction.alias("reduction"))

    def upset(self) -> DataFrame:
        """The counter with one boolean column for each prefix, for plots."""
        return self.counter().select(*(F.array_contains("prefixes", p).alias(p) for p in self.priority), "n")

    def describe(self) -> str:
        """The summary in prose."""
        r = self.summary().first()
        share = lambda n: f"{n:,} ({n / max(1, r.reduced):.1%})"
        return (
            f"This estimates a total of {r.reduced:,} unique entities.\n\n- {share(r.at_least_1)} have at least one mapping.\n"
            f"- {share(r.only_1)} are unique to a single resource.\n- {share(r.conserved)} appear in all {len(self.priority)} resources.\n\n"
            f"From {r.total:,} terms this is a reduction by {r.reduction or 0:.1%}.\n"
        )


def analyze(processed: DataFrame, priority: list[str], exact: DataFrame, observed: DataFrame) -> Landscape:
    ws = Workspace(processed.sparkSession, "landscape")
    mapped = ws.save(component_sizes(processed, priority), "mapped")
    single = counts.unobserved(priority, exact, observed).select(F.array("prefix").alias("prefixes"), "n")
    total = counts.term_counts(priority, exact, observed).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return Landscape(mapped, ws.save(single, "single"), ws.save(total, "total"), priority)


def meta_analysis(landscapes: dict[str, Landscape]) -> DataFrame:
    """One line for each domain: its name and summary."""
    out = None
    for name, one in landscapes.items():
        line = one.summary().select(F.lit(name).alias("domain"), "*")
        out = line if out is None else out.unionByName(line)
    if out is None:
        raise ValueError("no landscapes")
    return out
