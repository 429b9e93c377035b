"""Helpers of the operators: table access, words, Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan.workspace import Workspace

#: White space of the contracts: [\x20\x09-\x0D], what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow batches are bounded in bytes, so very long texts can't pile up in a worker.
ARROW_ROWS, ARROW_BYTES = 4000, 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scanned(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` if it is a plain scan of files; otherwise it is written once and read back."""
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return docs if plan == "LogicalRelation" else ws.save(docs, "docs")


def row_id(scan: DataFrame) -> Column:
    """A row's file and position in it: tells rows of equal or null key apart, and is the same whenever the files are read."""
    at = scan.metadataColumn("_metadata")
    return F.struct(at["file_path"].alias("file"), at["row_index"].alias("at"))


def numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with its rows' ids as ``__row``."""
    scan = scanned(docs, ws)
    return scan.withColumn("__row", row_id(scan))


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, by rows and bytes, for the session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, **kw) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are left out."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema, **kw)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def joined_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words joined by one blank, and where each begins and ends; no object a word, so long texts stay small."""
    data = np.frombuffer(text, np.uint8)
    space = _IS_SPACE[data]
    keep = ~space
    keep[1:] |= keep[:-1]  # and the white space right after a word
    out = np.where(space, np.uint8(0x20), data)[keep]
    if len(out) and out[-1] == 0x20:
        out = out[:-1]
    cuts = np.flatnonzero(out == 0x20)
    if not len(out):
        return b"", cuts, cuts
    return out.tobytes(), np.r_[0, cuts + 1], np.r_[cuts, len(out)]
