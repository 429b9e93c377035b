"""Reversible line dedup: exact reference counts with sharded cuckoo filters.

The index holds for each line key the number of documents it occurs in, and for
each shard of the frequent keys a cuckoo filter.  Documents can be inserted and
deleted: counts are added or subtracted, and keys that cross the threshold enter or
leave their shard's filter, so a deletion restores what an insertion changed.  A
filter is filled anew when its load passes ``LOAD``, and all are when frequent keys
ask for more shards.

In ``dedup`` the filters decide: a line that its filter doesn't hold stays, one that
it holds goes.  Filters never miss a frequent key.  What they let pass is confirmed by
a join with the exact counts, and the few keys that this refutes (16-bit fingerprints
agree by chance) go along with the filters as exceptions.  Filters or exceptions too
large for a task's memory (``broadcast_bytes``) are met by shuffling keys instead.

A key is the 128-bit XXH3 hash of the line, stripped of ``[\\x20\\x09-\\x0D]`` at
both ends and lower-cased in A-Z.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; a line repeated within a document
counts once for it; repeated rows and rows of equal key are documents of their own;
a very long text is split into lines as a whole; an empty table gives an empty index
and no rows; null document keys and extra columns pass through, but columns named
``n_lines``, ``n_dropped`` and ``kept_text`` clash with the result's own and can't be told apart.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan.llm.common import arrow_map, batch, bounded_batches, numbered, raw
from veldspan.workspace import Workspace

SPACE = b" \t\n\r\x0b\x0c"
#: Filters, and exceptions, up to this size go to every task; larger ones are met by shuffling.
BROADCAST_BYTES = 32 << 20
#: Frequent keys of a shard, about, and the load at which its filter is filled anew.
SHARD_KEYS, LOAD = 1 << 17, 0.9
_SLOTS, _KICKS, _SPREAD = 4, 500, 0x5BD1E995
#: What a key takes in a task's set.
_KEY_BYTES = 100
_TAILS = bytes(range(0x80, 0xC0))


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars or len(key.translate(None, _TAILS)) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Fan et al. (CoNEXT 2014): 16-bit fingerprints, buckets of 4, deletions."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None, stash: set[bytes] | None = None):
        if table is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / _SLOTS / 0.9))))
            table = np.zeros((buckets, _SLOTS), np.uint16)
        self.table, self.stash = table, stash or set()  # the stash holds whole keys that found no place

    def _places(self, key: bytes) -> tuple[int, int, int]:
        f = int.from_bytes(key[:2], "little") or 1
        i = int.from_bytes(key[4:8], "little") & (len(self.table) - 1)
        return f, i, self._other(i, f)

    def _other(self, i: int, f: int) -> int:
        return (i ^ (f * _SPREAD)) & (len(self.table) - 1)

    def insert(self, key: bytes) -> None:
        f, i, j = self._places(key)
        for b in (i, j):
            if len(free := np.flatnonzero(self.table[b] == 0)):
                self.table[b, free[0]] = f
                return
        moves = []
        for k in range(_KICKS):
            slot = (f + k) % _SLOTS
            moves.append((i, slot, int(self.table[i, slot])))
            f, self.table[i, slot] = moves[-1][2], f
            i = self._other(i, f)
            if len(free := np.flatnonzero(self.table[i] == 0)):
                self.table[i, free[0]] = f
                return
        for i, slot, was in reversed(moves):
            self.table[i, slot] = was
        self.stash.add(key)

    def delete(self, key: bytes) -> None:
        if key in self.stash:
            self.stash.discard(key)
            return
        f, i, j = self._places(key)
        for b in (i, j):
            if len(at := np.flatnonzero(self.table[b] == f)):
                self.table[b, at[0]] = 0
                return

    def __contains__(self, key: bytes) -> bool:
        f, i, j = self._places(key)
        return f in self.table[i] or f in self.table[j] or key in self.stash

    def dump(self) -> bytes:
        return len(self.table).to_bytes(8, "little") + self.table.tobytes() + b"".join(sorted(self.stash))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        n = int.from_bytes(data[:8], "little")
        end = 8 + n * _SLOTS * 2
        stash = {data[k : k + 16] for k in range(end, len(data), 16)}
        return cls(table=np.frombuffer(data[8:end], np.uint16).reshape(n, _SLOTS).copy(), stash=stash)


class Filters:
    """Many shards' filters, asked for many keys at once."""

    def __init__(self, dumps: dict[int, bytes], shards: int):
        self.shards, self.stash = shards, set()
        none = np.zeros((1, _SLOTS), np.uint16)
        tables = {k: CuckooFilter.load(v) for k, v in dumps.items()}
        for f in tables.values():
            self.stash |= f.stash
        each = [tables[k].table if k in tables else none for k in range(shards)]
        sizes = np.array([len(t) for t in each], np.uint64)
        self.base, self.mask = np.cumsum(sizes) - sizes, sizes - np.uint64(1)
        self.table = np.concatenate(each)

    def hold(self, keys: np.ndarray) -> np.ndarray:
        """Of keys as rows of 16 bytes."""
        shard = shard_of(keys, self.shards)
        f = np.maximum(np.ascontiguousarray(keys[:, :2]).view("<u2").ravel(), 1)
        i = np.ascontiguousarray(keys[:, 4:8]).view("<u4").ravel().astype(np.uint64) & self.mask[shard]
        j = (i ^ (f.astype(np.uint64) * np.uint64(_SPREAD))) & self.mask[shard]
        out = np.zeros(len(keys), bool)
        for at in (i, j):
            out |= (self.table[(self.base[shard] + at).astype(np.int64)] == f[:, None]).any(1)
        if self.stash:
            out |= np.fromiter((k.tobytes() in self.stash for k in keys), bool, len(keys))
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (np.ascontiguousarray(keys[:, 8:12]).view(">u4").ravel().astype(np.int64)) % shards


def _shard(shards: int) -> F.Column:
    """The same in SQL."""
    return F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("long") % shards


def count_keys(docs: DataFrame, text: str, sign: int, min_chars: int) -> DataFrame:
    """``(key, n)``: documents that hold each key, summed within a batch before the shuffle."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        n = Counter()
        for t in raw(b.column(0)):
            n.update({line_key(x, min_chars) for x in t.split(b"\n")} - {None})
        return batch(key=pa.array(list(n), pa.binary()), n=pa.array([sign * x for x in n.values()], pa.int64()))

    return arrow_map(docs.select(text), each, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _line_keys(texts: list[bytes], min_chars: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Lines of each text; of all lines, the keys as rows of 16 bytes and whether there is one."""
    lines = [t.split(b"\n") for t in texts]
    keys = [line_key(x, min_chars) for own in lines for x in own]
    some = np.fromiter((k is not None for k in keys), bool, len(keys))
    return [len(x) for x in lines], np.frombuffer(b"".join(k or bytes(16) for k in keys), np.uint8).reshape(-1, 16), some


class LineIndex:
    """Immutable versions of the exact counts and the filters in ``path``."""

    def __init__(self, spark: SparkSession, *, threshold: int = 10, min_chars: int = 1, shards: int = 8, shard_keys: int = SHARD_KEYS, workspace: Workspace | None = None):
        self.spark, self.threshold, self.min_chars, self.shards, self.shard_keys = spark, threshold, min_chars, shards, shard_keys
        self.ws, self.version = workspace or Workspace(spark, "lines"), 0
        self.counts = spark.createDataFrame([], "key binary, n long")
        self.filters = spark.createDataFrame([], "shard long, filter binary, n long, slots long")

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._update(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take back documents that were inserted before."""
        return self._update(docs, text, -1)

    def _update(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        t, k = self.threshold, self.version + 1
        delta = count_keys(docs, text, sign, self.min_chars)
        if self.version:
            delta = self.ws.save(delta, f"delta{k}")
            both = delta.withColumnRenamed("n", "d").join(self.counts, "key", "full")
            both = both.select("key", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"))
        else:
            both = delta.select("key", F.lit(0).cast("long").alias("was"), "n")
        both = self.ws.save(both.where("n > 0 OR was > 0"), f"both{k}")
        total = both.where(f"n >= {t}").count()
        shards = max(self.shards, 1 << max(0, int(np.ceil(np.log2(max(1, total) / self.shard_keys)))))
        new = LineIndex(self.spark, threshold=t, min_chars=self.min_chars, shards=shards, shard_keys=self.shard_keys, workspace=self.ws)
        new.version, new.counts = k, both.where("n > 0").select("key", "n")
        old = self.filters if shards == self.shards else self.filters.limit(0)  # more shards: all filters are filled anew
        both = both.withColumn("shard", _shard(shards))
        # which filters are filled anew: a line for each shard
        plan = both.where(f"n >= {t}").groupBy("shard").agg(F.count("*").alias("frequent")).join(old.select("shard", "slots"), "shard", "left")
        plan = plan.select("shard", "frequent", F.coalesce(F.col("frequent") > F.col("slots") * LOAD, F.lit(True)).alias("fresh"))
        changes = both.where(f"n >= {t} OR was >= {t}").join(plan, "shard", "left")
        crosses = F.expr(f"(n >= {t}) <> (was >= {t})")
        changes = changes.where(F.when(F.coalesce("fresh", F.lit(False)), F.col("n") >= t).otherwise(crosses))
        changes = changes.select("shard", "key", (F.col("n") >= t).alias("enters"), F.coalesce("frequent", F.lit(0)).alias("frequent"), F.coalesce("fresh", F.lit(False)).alias("fresh"))

        def update(key: tuple, changes: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            frequent = int(changes["frequent"].max()) if len(changes) else int(old["n"].iloc[0])
            fresh = bool(changes["fresh"].any()) if len(changes) else False
            f = CuckooFilter.load(old["filter"].iloc[0]) if len(old) and not fresh else CuckooFilter(2 * frequent)
            for k, enters in zip(changes["key"], changes["enters"], strict=True):
                f.insert(k) if enters else f.delete(k)
            return pd.DataFrame({"shard": [key[0]], "filter": [f.dump()], "n": [frequent], "slots": [f.table.size]})

        merged = changes.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(update, "shard long, filter binary, n long, slots long")
        new.filters = self.ws.save(merged, f"filters{k}")
        return new

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.threshold).select("key")

    def dedup(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        if size > broadcast_bytes:
            return self._dedup_joined(docs, text, None)
        filters = self.spark.sparkContext.broadcast({k: bytes(v) for k, v in self.filters.select("shard", "filter").collect()})
        passing = self.ws.save(arrow_map(docs.select(text), self._passing(filters), "key binary").distinct(), f"passing-{uuid.uuid4().hex}")
        refuted = self.ws.save(passing.join(self.frequent(), "key", "left_anti"), f"refuted-{uuid.uuid4().hex}")
        if refuted.count() * _KEY_BYTES > broadcast_bytes:
            return self._dedup_joined(docs, text, filters)
        return self._dedup_mapped(docs, text, filters, {bytes(r[0]) for r in refuted.collect()})

    def _passing(self, filters) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """A batch's distinct keys that the filters hold."""
        shards, min_chars, state = self.shards, self.min_chars, {}

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            if not state:
                state["filters"] = Filters(filters.value, shards)
            _, keys, some = _line_keys(raw(b.column(0)), min_chars)
            found = {k.tobytes() for k in keys[some & state["filters"].hold(keys)]}
            return batch(key=pa.array(list(found), pa.binary()))

        return each

    def _dedup_mapped(self, docs: DataFrame, text: str, filters, exceptions: set[bytes]) -> DataFrame:
        """Filters and exceptions, of checked sizes, go to every task."""
        sent = self.spark.sparkContext.broadcast(exceptions)
        shards, min_chars, names, state = self.shards, self.min_chars, docs.columns, {}
        bounded_batches(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not state:
                state["filters"] = Filters(filters.value, shards)
            for b in batches:
                sizes, keys, some = _line_keys(raw(b.column(names.index(text))), min_chars)
                drop = some & state["filters"].hold(keys)
                if sent.value:
                    at = np.flatnonzero(drop)
                    drop[at] = [k.tobytes() not in sent.value for k in keys[at]]
                ends = np.cumsum(sizes).tolist()
                yield _kept(b, text, names, [drop[z - n : z].tolist() for z, n in zip(ends, sizes, strict=True)])

        return docs.mapInArrow(run, _out_schema(docs))

    def _dedup_joined(self, docs: DataFrame, text: str, filters) -> DataFrame:
        """Too much for every task: a document's keys, those that pass the filters if these fit, meet the counts by shuffling.

        A row's file and position tie a document's dropped keys to it again, so repeated
        or null document keys do no harm; hot keys are split by adaptive joins.
        """
        names, min_chars, shards, state = docs.columns, self.min_chars, self.shards, {}
        own = numbered(docs.toDF(*(f"c{i}" for i in range(len(names)))), self.ws)
        at = f"c{names.index(text)}"

        def keys(b: pa.RecordBatch) -> pa.RecordBatch:
            if filters is not None and not state:
                state["filters"] = Filters(filters.value, shards)
            sizes, found, some = _line_keys(raw(b.column(1)), min_chars)
            if filters is not None:
                some &= state["filters"].hold(found)
            row = np.repeat(np.arange(b.num_rows), sizes)[some]
            pairs = list(dict.fromkeys(zip(row.tolist(), map(bytes, found[some]), strict=True)))
            return batch(__row=b.column(0).take(pa.array([x[0] for x in pairs], pa.int64())), key=pa.array([x[1] for x in pairs], pa.binary()))

        rows, own = own, arrow_map(own.select("__row", at), keys, "__row struct<file string, at long>, key binary")
        drop = own.join(self.frequent(), "key").groupBy("__row").agg(F.collect_set("key").alias("__drop"))  # within one document
        joined = rows.join(drop, "__row", "left").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "__drop")
        bounded_batches(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dropped = [set(x or ()) for x in b.column(len(names)).to_pylist()]
                texts = raw(b.column(names.index(text)))
                yield _kept(b, text, names, [[line_key(x, min_chars) in d for x in t.split(b"\n")] for t, d in zip(texts, dropped, strict=True)])

        return joined.mapInArrow(run, _out_schema(docs))


def _out_schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long, kept_text string"


def _kept(b: pa.RecordBatch, text: str, names: list[str], dropped: list[list[bool]]) -> pa.RecordBatch:
    kept = []
    for t, d in zip(raw(b.column(names.index(text))), dropped, strict=True):
        kept.append(b"\n".join(x for x, out in zip(t.split(b"\n"), d, strict=True) if not out) if any(d) else t)
    more = [pa.array([len(d) for d in dropped], pa.int64()), pa.array([sum(d) for d in dropped], pa.int64()), pa.array([k.decode() for k in kept], pa.string())]
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *more], [*names, "n_lines", "n_dropped", "kept_text"])
