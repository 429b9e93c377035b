"""Shared scratch tables: where lineage is cut and intermediate results live.

A cluster names a folder that all executors share in ``spark.checkpoint.dir``.
It is read from the session; only where it is unset (tests, notebooks) a
temporary folder of this machine is set in its place.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: HotSpot doesn't compile methods beyond this; larger plans are faster with their expressions split into several.
_METHOD, _MOST = "spark.sql.codegen.hugeMethodLimit", "8000"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if at := sc.getCheckpointDir():
        return at.rsplit("/", 1)[0] if _is_uuid(at.rsplit("/", 1)[-1]) else at
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="veldspan-")
    sc.setCheckpointDir(at)
    return at


def _is_uuid(name: str) -> bool:
    with contextlib.suppress(ValueError):
        uuid.UUID(name)
        return True
    return False


_scopes: list[list[Workspace]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Scratch tables that are made within are removed at the end: for results that have been written or read by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for ws in _scopes.pop():
            ws.drop()


def compiled(spark: SparkSession) -> None:
    """Let long expressions be compiled, for this session."""
    if spark.conf.get(_METHOD, None) != _MOST:
        spark.conf.set(_METHOD, _MOST)


class Workspace:
    """A folder of scratch tables of one run; tables can be dropped early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        compiled(spark)
        self.path = f"{shared_dir(spark)}/veldspan-{label}-{uuid.uuid4().hex[:12]}"
        if _scopes:
            _scopes[-1].append(self)

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` (its shuffle files go once it is written) and read it back."""
        at, conf = f"{self.path}/{name}", self.spark.conf
        before = conf.get(_CLEAN, None)
        with contextlib.suppress(Exception):  # a setting that this Spark may not have
            conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(at)
        finally:
            with contextlib.suppress(Exception):
                conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        remove(self.spark, f"{self.path}/{name}" if name else self.path)


def literal(spark: SparkSession, data: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as literals of the plan: unlike those of ``createDataFrame`` the planner knows that they are few."""
    types = StructType.fromDDL(schema).fields
    if not data:
        return spark.createDataFrame([], schema)
    lines = (F.struct(*(F.lit(v).cast(t.dataType).alias(t.name) for v, t in zip(row, types, strict=True))) for row in data)
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*lines)))


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_text(spark: SparkSession, uri: str, text: str, *, private: bool = False) -> None:
    """A small file, through Hadoop's file systems; only its owner may read a ``private`` one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    if private:
        fs.setPermission(path, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    out.write(bytearray(text.encode()))
    out.close()
