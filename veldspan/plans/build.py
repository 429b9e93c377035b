"""The raw database: every source into a partition of its own, failures kept apart.

``sources/<kind>/<key>`` is a source's cache.  One that exists is not read again; one
that fails is reported and skipped.  All sinks then read the one partitioned folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan import graph
from veldspan.schema import ROW, ROW_SCHEMA
from veldspan.sinks.files import write_jsonl, write_parquet, write_property_graph
from veldspan.sinks.sssom import write_sssom
from veldspan.sources.files import exists
from veldspan.workspace import Workspace, scratch

Task = tuple[str, str, Callable[[], DataFrame]]
SUMMARY_SCHEMA = "kind string, key string, seconds double, cached boolean, error string"


def build(spark: SparkSession, directory: str, tasks: Iterable[Task], *, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, summary)`` of ``(kind, key, load)``; rows carry ``kind`` and ``key``, partitions of the folder."""
    done = []
    for kind, key, load in tasks:
        at, began, error = f"{directory}/sources/kind={kind}/key={key}", time.time(), None
        cached = exists(spark, f"{at}/_SUCCESS") and not refresh
        if not cached:
            try:
                write_parquet(load(), at)
            except Exception as e:  # one source must not stop the others
                error = f"{type(e).__name__}: {e}"[:500]
        done.append((kind, key, round(time.time() - began, 3), cached, error))
    good = [f"{directory}/sources/kind={kind}/key={key}" for kind, key, _, _, error in done if error is None]
    summary = spark.createDataFrame(done, SUMMARY_SCHEMA)
    if good:
        rows = spark.read.schema(f"{ROW_SCHEMA}, kind string, key string").option("basePath", f"{directory}/sources").parquet(*good)
    else:
        rows = spark.createDataFrame([], f"{ROW_SCHEMA}, kind string, key string")
    sizes = rows.groupBy("kind", "key").agg(F.count("*").alias("n"))
    return rows, summary.join(sizes, ["kind", "key"], "left").fillna({"n": 0})


def export(rows: DataFrame, directory: str, *, sets: DataFrame, set_id: str) -> None:
    """The whole database as JSON lines, SSSOM and property graph, each written in parallel beside the sources."""
    rows = rows.select(*ROW)
    with scratch():
        write_jsonl(rows, f"{directory}/mappings.jsonl")
        write_sssom(rows, f"{directory}/mappings.sssom.tsv", set_id=set_id, sets=sets, single_file=False)
        write_property_graph(graph.build(rows, sets, ws=Workspace(rows.sparkSession, "database")), f"{directory}/graph")


def tabulate(summary: DataFrame) -> DataFrame:
    """Sources that gave rows, most first."""
    return summary.where("n > 0").orderBy(F.desc("n"), "kind", "key")
