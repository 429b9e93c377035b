"""Raw rows as they arrive: a file stream, repeats removed, each batch written once.

The index of evidence that was seen is the store itself: a batch is anti-joined with
the ids, and nothing else, of those shards of the store that it has ids in.  So state
does not live in memory and grows on disk alone.  A batch is known by its stream's run,
which a checkpoint keeps, and its number: writing it again after a failure overwrites
the same partitions, and a stream with another checkpoint, whose numbers start again,
never does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldspan.functions.refs import evidence_id
from veldspan.operators.assemble import deduplicate_evidence
from veldspan.schema import ROW, ROW_SCHEMA
from veldspan.sources.files import exists

SHARDS = 64


def stream_rows(spark: SparkSession, path: str, *, max_files: int = 100) -> DataFrame:
    """A stream over a folder of Parquet rows."""
    return spark.readStream.schema(ROW_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """All rows ingested so far."""
    return spark.read.schema(f"{ROW_SCHEMA}, ev_id string, shard int, run string, batch long").parquet(store)


def append_batch(batch: DataFrame, batch_id: int, store: str, run: str = "", shards: int = SHARDS) -> None:
    """Write what the store doesn't have yet; running a batch again gives the same."""
    spark = batch.sparkSession
    own = deduplicate_evidence(batch).withColumn("ev_id", evidence_id())
    own = own.withColumn("shard", F.pmod(F.xxhash64("ev_id"), F.lit(shards)).cast("int"))
    if exists(spark, store):
        touched = [r.shard for r in own.select("shard").distinct().collect()]  # as many as there are shards at most
        earlier = stored(spark, store).where(F.col("shard").isin(touched) & ((F.col("batch") != batch_id) | (F.col("run") != run)))
        own = own.join(earlier.select("shard", "ev_id"), ["shard", "ev_id"], "left_anti")
    out = own.select(*ROW, "ev_id", "shard", F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "run", "batch").parquet(store)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint keeps over restarts."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id


def ingest(rows: DataFrame, store: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Start the stream into ``store``; ``checkpoint`` holds its progress."""
    spark = rows.sparkSession
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: append_batch(df, k, store, _run_of(spark, checkpoint)))
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``(start, kind, n)`` of an event stream or table, with a watermark on late rows."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    out = own.groupBy(F.window(time, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "kind", "n")
