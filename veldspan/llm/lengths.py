"""Token counts from an exact length histogram.

Documents are aggregated by encoded length.  Suffix sums over the distinct
lengths answer every question about context limits: totals, quantiles, and the
total that is left when each document is cut off at a limit, since
``sum(min(length, L)) = tokens of documents up to L + L * documents beyond``.

Suffix sums run in two levels (blocks of lengths, then within a block), so no
task holds all lengths.

Defined results: a null text is empty; repeated rows count each; ties (documents of
equal length) are one line; null keys don't matter; a very long text is encoded whole;
extra columns, of whatever name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspan.llm.common import arrow_map, batch, raw
from veldspan.llm.encode import encoder
from veldspan.workspace import Workspace

#: Lengths in a block of the suffix sums.
BLOCK = 256


def encoded_lengths(docs: DataFrame, vocabulary: str, *, text: str = "text", extra: int = 1) -> DataFrame:
    """``(n_tokens, n_docs)`` by partial counts of each batch; ``extra`` ids end each document."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(vocabulary)
        return batch(n_tokens=pa.array([len(x) // enc.width + extra for x in enc.encode(raw(b.column(0)))], pa.int64()))

    return arrow_map(docs.select(text), each, "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def histogram(lengths: DataFrame) -> DataFrame:
    """Of each distinct length: documents and tokens at, from and beyond it, and the truncated total."""
    own = lengths.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    none = F.lit(0).cast("long")
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), none).alias("docs_after"), F.coalesce(F.sum("t").over(after), none).alias("tokens_after"))
    everything = own.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    own = own.join(blocks, "block").join(F.broadcast(everything))  # one row
    docs_from = F.col("docs_after") + F.sum("n_docs").over(within)
    tokens_from = F.col("tokens_after") + F.sum("tokens").over(within)
    own = own.select("*", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"))
    docs_to = F.col("all_docs") - F.col("docs_from") + F.col("n_docs")
    return own.select(
        "n_tokens", "n_docs", "tokens", "docs_from", "tokens_from", docs_to.alias("docs_to"),
        # a document of this rank, of all, has this length or less
        (docs_to / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
    )


def token_counts(docs: DataFrame, vocabulary: str, *, text: str = "text", extra: int = 1) -> DataFrame:
    ws = Workspace(docs.sparkSession, "lengths")
    return histogram(ws.save(encoded_lengths(docs, vocabulary, text=text, extra=extra), "lengths"))


def truncated(hist: DataFrame, limit: int) -> DataFrame:
    """``(limit, total, kept, docs_cut)`` for any context limit, met by a document or not."""
    n = F.col("n_tokens")
    return hist.agg(
        F.lit(limit).alias("limit"), F.sum("tokens").alias("total"), F.sum(F.least(n, F.lit(limit)) * F.col("n_docs")).alias("kept"),
        F.sum(F.when(n > limit, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
    )
