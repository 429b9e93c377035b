"""From rows to mappings: one evidence once, one confidence for each triple.

Both steps are aggregates with partial sums before the shuffle, so a triple with
very many rows costs a task one partial result from each map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.functions.confidence import noisy_or
from veldspan.functions.refs import evidence_id, triple_id
from veldspan.schema import IDENTITY, PAYLOAD, ROW, TRIPLE


def deduplicate_evidence(rows: DataFrame) -> DataFrame:
    """One row of each evidence of a triple; of rows that differ in payload alone, one stays whole: the greatest, nulls least."""
    whole = F.max(F.struct(*PAYLOAD)).alias("payload")
    first = F.xxhash64(*TRIPLE, *IDENTITY).alias("_hash")  # such a maximum sorts by the keys: a hash decides nearly all comparisons
    return rows.groupBy(first, *TRIPLE, *IDENTITY).agg(whole).select(*TRIPLE, *IDENTITY, "payload.*").select(*ROW)


def confidences(rows: DataFrame) -> DataFrame:
    """``(triple, confidence)`` of each evidence, each once: what ``deduplicate_evidence`` keeps of it, without its payload's texts.

    Confidence leads the payload, so the greatest payload has the greatest confidence.  What evidence
    derives from counts by its 128-bit digest.
    """
    source = F.when(F.col("derived_from").isNotNull(), F.unhex(F.md5(F.array_join("derived_from", "\x01", "\x00")))).alias("_source")
    own = rows.groupBy(*TRIPLE, *(c for c in IDENTITY if c != "derived_from"), source).agg(F.max("confidence").alias("confidence"))
    return own.select(*TRIPLE, "confidence")


def assemble(rows: DataFrame) -> DataFrame:
    """All evidence of each triple together, each once."""
    return deduplicate_evidence(rows)


def mappings(rows: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """One line for each triple: ``confidence, n_evidence, has_primary, has_secondary, has_tertiary``.

    A mapping is primary if a set from its subject's own vocabulary has it,
    secondary if another set has it, tertiary if it is derived.  ``sets`` gives
    each set's ``source``; without it no row is primary or secondary.
    """
    rows = rows.select(*TRIPLE, "ev_type", "confidence", "ms_id")
    if sets is None:
        rows = rows.withColumn("source", F.lit(None).cast("string"))
    else:
        rows = rows.join(sets.select("ms_id", "source"), "ms_id", "left")
    simple = F.col("ev_type") == "simple"
    return rows.groupBy(*TRIPLE).agg(
        noisy_or("confidence").alias("confidence"), F.count("*").alias("n_evidence"),
        F.coalesce(F.bool_or(simple & (F.col("source") == F.col("s_prefix"))), F.lit(False)).alias("has_primary"),
        F.coalesce(F.bool_or(simple & (F.col("source") != F.col("s_prefix"))), F.lit(False)).alias("has_secondary"),
        F.bool_or(F.col("ev_type") == "reasoned").alias("has_tertiary"),
    )


def nested(rows: DataFrame) -> DataFrame:
    """Exchange form only: ``triple_id``, the triple, and its evidence as an array of structs.

    The array is as long as the triple has rows; inside the engine rows stay rows.
    """
    fields = [evidence_id().alias("ev_id"), "ev_type", "justification", "author", "row_confidence", "derived_from", "confidence", "ms_id", "explanation"]
    own = rows.select(*TRIPLE, F.struct(*fields).alias("e"))
    out = own.groupBy(*TRIPLE).agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    return out.select(triple_id().alias("triple_id"), *TRIPLE, "evidence")


def flat(mappings_: DataFrame) -> DataFrame:
    """The inverse of ``nested``."""
    return mappings_.select(*TRIPLE, F.explode("evidence").alias("e")).select(*TRIPLE, "e.*").select(*ROW)


def mapping_set_titles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Each triple's distinct set titles, sorted and joined by ``|``; derived rows name the sets of what they derive from."""
    own = rows.select(*TRIPLE, "ms_id", "derived_from")
    by_id = rows.where("ms_id IS NOT NULL").select(triple_id().alias("source_triple"), F.col("ms_id").alias("of_source")).distinct()
    derived = own.where(F.size("derived_from") > 0).select(*TRIPLE, F.explode("derived_from").alias("source_triple"))
    derived = derived.distinct().join(by_id, "source_triple").select(*TRIPLE, F.col("of_source").alias("ms_id"))
    all_ = own.where("ms_id IS NOT NULL").select(*TRIPLE, "ms_id").unionByName(derived).distinct()
    titled = all_.join(sets.select("ms_id", "title"), "ms_id").select(*TRIPLE, "title").distinct()
    return titled.groupBy(*TRIPLE).agg(F.array_join(F.array_sort(F.collect_set("title")), "|").alias("mapping_sets"))  # titles of sets, few
