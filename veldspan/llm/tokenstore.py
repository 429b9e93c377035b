"""Token ids in binary shards with a minimal perfect hash over document keys.

Shards hold raw little-endian ids, nothing else, in ascending key order.  Beside
each lies its index: a minimal perfect hash (levels of bit arrays, Limasset et
al., SEA 2017) that sends a document key to a slot, and for each slot the key's
fingerprint, the row of its first record, and each record's offset.  A lookup is
a few bit tests, one rank, one fingerprint comparison and one positioned read.
The keys themselves lie at the index's end, for scans only.

Tasks write shards under names of their own and report them in rows that Spark
commits, so a retried or lost task leaves at most an orphan that no manifest
names.  Files are written and read through pyarrow's file systems, in the folder
that all executors share.

Defined results: a null text is empty (it holds the end id alone); null keys come
first and share one key of their own, as which a key of -2**63 is held too; rows of
equal key are ordered by a hash of their text and all are kept; a very long text is
encoded whole and its ids are flushed in pieces; extra columns, of whatever name,
are not read; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspan.llm.common import bounded_batches, raw
from veldspan.llm.encode import encoder

END_ID = 1
NULL_KEY = -(1 << 63)
#: Ids of a shard are flushed in pieces of this many bytes.
FLUSH = 4 << 20
_GAMMA = 2
MANIFEST = "shard string, partition int, width int, n_docs long, n_tokens long, first_key long, last_key long, first_tie long"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of keys and a seed."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Distinct int64 keys to 0..n-1; unknown keys get some slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bytes of 0 and 1 in memory, bits on disk
        counts = [int(x.sum()) for x in levels]
        self.base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.int64).view(np.uint64)
        while len(left):
            m = max(8, _GAMMA * len(left))
            at = (_mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        left = keys.astype(np.int64).view(np.uint64)
        out = np.full(len(left), -1, np.int64)
        for k, level in enumerate(self.levels):
            todo = np.flatnonzero(out < 0)
            if not len(todo):
                break
            at = (_mix(left[todo], k) % np.uint64(len(level))).astype(np.int64)
            hit = level[at] == 1
            out[todo[hit]] = self.base[k] + self.ranks[k][at[hit]]
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for x in self.levels:
            parts += [struct.pack("<Q", len(x)), np.packbits(x).tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, data: memoryview) -> tuple[PerfectHash, int]:
        (n,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            (m,) = struct.unpack_from("<Q", data, at)
            size = (m + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 8), count=m))
            at += 8 + size
        return cls(levels), at


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64), 77) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray, lengths: np.ndarray) -> bytes:
    """Index of records in order; equal keys adjoin.  Lengths are in ids."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    distinct = keys[starts]
    h = PerfectHash.build(distinct)
    slot = h.slots(distinct)
    first, prints = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    first[slot], prints[slot] = starts, fingerprints(distinct)
    copies = np.zeros(len(distinct), np.uint32)
    copies[slot] = np.diff(np.r_[starts, len(keys)])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    head = struct.pack("<4sIQQ", b"VSX1", 0, len(distinct), len(keys))
    return head + prints.tobytes() + first.tobytes() + copies.tobytes() + offsets.tobytes() + h.dump() + keys.astype("<i8").tobytes()


class ShardIndex:
    def __init__(self, data: bytes):
        magic, _, n, rows = struct.unpack_from("<4sIQQ", data)
        if magic != b"VSX1":
            raise ValueError("not a shard index")
        at = 24
        self.prints, self.first, self.copies = (np.frombuffer(data, np.uint32, n, at + 4 * n * k) for k in range(3))
        self.offsets = np.frombuffer(data, np.uint64, rows + 1, at + 12 * n).astype(np.int64)
        rest = memoryview(data)[at + 12 * n + 8 * (rows + 1) :]
        self.hash, end = PerfectHash.load(rest)
        self.keys = np.frombuffer(rest, np.int64, rows, end)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of records of each key; -1 and 0 where the key isn't here."""
        slot = self.hash.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(keys[ok])
        slot = np.where(ok, slot, 0)
        if not len(self.first):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        return np.where(ok, self.first[slot].astype(np.int64), -1), np.where(ok, self.copies[slot].astype(np.int64), 0)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _ordered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sorted by key and text hash in contiguous ranges; many rows of one key spread over ranges."""
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), F.col(text).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    return own.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")


def write(docs: DataFrame, path: str, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` into shards below ``path``; returns the manifest, written there as Parquet."""
    spark = docs.sparkSession
    bounded_batches(spark)
    data = f"{path}/data"
    f, at = _open(data)
    f.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        keys, lengths, tie, out, name, pending, size = [], [], None, None, "", [], 0
        files, folder = _open(data)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                name = f"{part:06d}-{uuid.uuid4().hex}"
                out, tie = files.open_output_stream(f"{folder}/{name}.bin"), b.column(2)[0].as_py()
            ids = enc.encode(raw(b.column(1)))
            keys.append(b.column(0).to_numpy())
            lengths.append(np.fromiter((len(x) // enc.width + 1 for x in ids), np.int64, len(ids)))
            for x in ids:
                pending += [x, end]
                size += len(x)
                if size >= FLUSH:
                    out.write(b"".join(pending))
                    pending, size = [], 0
        if out is None:
            return
        out.write(b"".join(pending))
        out.close()
        k, n = np.concatenate(keys), np.concatenate(lengths)
        with files.open_output_stream(f"{folder}/{name}.idx") as index:
            index.write(build_index(k, n))
        row = {"shard": name, "partition": part, "width": enc.width, "n_docs": len(k), "n_tokens": int(n.sum()), "first_key": int(k[0]), "last_key": int(k[-1]), "first_tie": tie}
        types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

    _ordered(docs, key, text).mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Shards in key order with ``base``, the ids before each.  One row a shard."""
    order = Window.orderBy("first_key", "first_tie", "partition").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))


def read_back(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every record, read through the index."""
    data = f"{path}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, width, base in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                yield from _records(data, shard, np.dtype("<u2" if width == 2 else "<u4"), base)

    shards = read_manifest(spark, path).select("shard", "width", "base")
    n = max(1, shards.count())  # a task for each shard, as in writing; few small rows would else end in one task
    rows = shards.repartitionByRange(n, "base", "shard").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")
    return rows.select(F.nullif("key", F.lit(NULL_KEY)).alias(key), "start", "n_tokens", "ids_crc32")


def _records(data: str, shard: str, dtype: np.dtype, base: int, step: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The shard's records, ``step`` keys at a time: each key is looked up, and read at the offsets that its slot leads to."""
    files, folder = _open(data)
    with files.open_input_file(f"{folder}/{shard}.idx") as f:
        index = ShardIndex(f.read())
    keys = index.keys[np.flatnonzero(np.r_[True, index.keys[1:] != index.keys[:-1]])] if len(index.keys) else index.keys
    with files.open_input_file(f"{folder}/{shard}.bin") as f:
        for a in range(0, len(keys), step):
            own = keys[a : a + step]
            first, copies = index.find(own)
            if (first < 0).any():
                raise ValueError(f"shard {shard}: its index doesn't lead to all of its keys")
            begun = np.cumsum(copies) - copies
            rows = np.repeat(first - begun, copies) + np.arange(int(copies.sum()))
            begin, end = index.offsets[rows], index.offsets[rows + 1]
            crc, at = [], -1
            for x, z in zip(begin.tolist(), end.tolist(), strict=True):
                if x != at:
                    f.seek(x * dtype.itemsize)
                at = z
                crc.append(zlib.crc32(np.frombuffer(f.read((z - x) * dtype.itemsize), dtype).astype("<u4")))
            columns = [np.repeat(own, copies), base + begin, end - begin, np.array(crc, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "start", "n_tokens", "ids_crc32"])


class TokenStore:
    """Keyed access: ``get(key)`` reads the ids of a document's records."""

    def __init__(self, spark: SparkSession, path: str):
        self.data = f"{path}/data"
        rows = read_manifest(spark, path).orderBy("base", "first_key", "first_tie").collect()  # one row a shard
        self.shards, self._index = rows, {}

    def _load(self, shard: str) -> ShardIndex:
        if shard not in self._index:
            files, folder = _open(self.data)
            with files.open_input_file(f"{folder}/{shard}.idx") as f:
                self._index[shard] = ShardIndex(f.read())
        return self._index[shard]

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each record with this key, in file order; none if the key is unknown."""
        k, out = NULL_KEY if key is None else key, []
        files, folder = _open(self.data)
        for s in self.shards:
            if not s["first_key"] <= k <= s["last_key"]:
                continue
            index = self._load(s["shard"])
            row, copies = (int(x[0]) for x in index.find(np.array([k], np.int64)))
            dtype = np.dtype("<u2" if s["width"] == 2 else "<u4")
            with files.open_input_file(f"{folder}/{s['shard']}.bin") as f:
                for r in range(row, row + copies):
                    lo, hi = int(index.offsets[r]), int(index.offsets[r + 1])
                    f.seek(lo * s["width"])
                    out.append(np.frombuffer(f.read((hi - lo) * s["width"]), dtype).astype(np.uint32))
        return out
