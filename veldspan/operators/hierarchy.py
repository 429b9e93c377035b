"""Hierarchy closure and vocabularies' term lists.

``is_a (child_prefix, child_id, parent_prefix, parent_id)`` is an edge table;
``terms (prefix, id)`` lists vocabularies in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.workspace import Workspace


def descendants(is_a: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``(root_prefix, root_id, prefix, id)``: all descendants of each of ``roots (prefix, id)``; cycles end.

    A frontier loop: each round joins only what the last one found, and what is
    known already is taken out by an anti join.
    """
    ws = Workspace(is_a.sparkSession, "hierarchy")
    edges = is_a.select("child_prefix", "child_id", F.col("parent_prefix").alias("prefix"), F.col("parent_id").alias("id")).distinct()
    keys = ["root_prefix", "root_id", "prefix", "id"]
    frontier = roots.select(F.col("prefix").alias("root_prefix"), F.col("id").alias("root_id"), "prefix", "id").distinct()
    found = None
    for k in range(most_rounds):
        new = frontier.join(edges, ["prefix", "id"]).select("root_prefix", "root_id", F.col("child_prefix").alias("prefix"), F.col("child_id").alias("id")).distinct()
        if found is not None:
            new = new.join(found, keys, "left_anti")
        frontier = ws.save(new, f"round{k}")
        if frontier.isEmpty():
            break
        found = frontier if found is None else found.unionByName(frontier)
    else:
        raise RuntimeError(f"hierarchy is deeper than {most_rounds}")
    return frontier if found is None else found


def hydrate_subsets(roots: DataFrame, is_a: DataFrame) -> DataFrame:
    """``roots (prefix, ref_prefix, ref_id)`` to ``terms (prefix, id)``: descendants of that prefix, and the root itself if it has it."""
    refs = roots.select(F.col("ref_prefix").alias("prefix"), F.col("ref_id").alias("id")).distinct()
    closed = descendants(is_a, refs).select(F.col("root_prefix").alias("ref_prefix"), F.col("root_id").alias("ref_id"), F.col("prefix").alias("found_prefix"), "id")
    below = roots.join(closed, ["ref_prefix", "ref_id"]).where("found_prefix = prefix").select("prefix", "id")
    own = roots.where("ref_prefix = prefix").select("prefix", F.col("ref_id").alias("id"))
    return below.unionByName(own).distinct()


def vocabulary_terms(terms: DataFrame, prefixes: list[str], subset: DataFrame | None = None) -> DataFrame:
    """The vocabularies' terms; of one with a subset only its members, without local ids (``prefix#...``)."""
    own = terms.where(F.col("prefix").isin(prefixes)).select("prefix", "id").distinct()
    if subset is None:
        return own
    limited = subset.select("prefix").distinct().withColumn("limited", F.lit(True))
    member = subset.select("prefix", "id").distinct().withColumn("member", F.lit(True))
    own = own.join(limited, "prefix", "left").join(member, ["prefix", "id"], "left")
    local = F.startswith("id", F.concat("prefix", F.lit("#")))
    return own.where(F.col("limited").isNull() | (F.col("member") & ~local)).select("prefix", "id")
