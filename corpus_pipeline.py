"""A corpus from raw documents: quality, near-duplicates, benchmark leaks, mixture, token shards.

Defined results of all stages: null and empty texts are documents without words;
repeated rows are rows of their own; ties are broken by key, then by a row's file and
place in it; a very long text is read whole; extra columns, of whatever name, pass by
untouched through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from veldspan.llm import decontaminate, mixing, quality, resemblance, tokenstore
from veldspan.llm.common import documents
from veldspan.llm.queries import vocabulary
from veldspan.workspace import Workspace, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie beyond their group's thresholds go; so do null, empty and short texts."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: linked by five-word similarity of 0.8 or more, or by SimHash.

    The smallest key stays, of equal keys the first row; null keys stay only where their group has no other.
    """
    return resemblance.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold one whole window of a benchmark item go, null keys and repeated rows each by itself."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as the sources' targets ask; null is a source; one without words gives nothing."""
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards; the records as they read back: null keys first, a null text as its end id alone."""
    path = Workspace(spark, "pipeline-tokens").path
    tokenstore.write(docs, path, vocabulary())
    return tokenstore.read_back(spark, path)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("SimHash and MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("token shards", token_shards),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    ws, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        # what a stage has left behind goes once its rows are written, but for the last, whose shards are the result
        with scratch() if k + 1 < len(STAGES) else nullcontext():
            out = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
        docs = out
    return docs
