"""Substring dedup with a log-structured index of window hashes.

Documents in ascending key order form blocks, which keep their words as numbers
into the block's own vocabulary, so a text is split once.  A block's distinct
window hashes, in order, go to shards by their leading bits.  A shard's task
merge-joins them with each other and with the shard's runs: immutable sorted
files of the windows of past batches.  A 64-bit hash that is met before makes a
candidate; it is verified by the stored fingerprint, 16 bits of a second hash
that is built on hashes of the words of its own.  Answers go back to blocks as
bit masks over their sorted hashes, so no positions travel.

What a batch adds is one run a shard, written by the task that has merged it.
Runs are compacted into one in turns: each batch compacts the shards whose turn
it is, every ``FANOUT``-th, so a shard holds few runs and a compaction needs
room for a part of the index only.  When the windows of index and batch outgrow
``SHARD_WINDOWS`` a shard, shards split by further leading bits; old runs are
then read by ranges, which their directories allow, until they are compacted.

A window is ``width`` consecutive words of one document (``[^\\x20\\x09-\\x0D]+``,
unchanged).  Each word that is covered by a window whose words also start in a
document of a smaller key is removed; windows are judged on the input.  Documents
in the index are earlier than any of a new batch.  Two windows are held equal if
80 bits of two hashes agree: among a trillion windows one wrong match is expected.

A run holds a window once, however often documents repeat it, so a passage that
all documents share costs a shard one entry a block.  Rows of one key never share a
block with others at the edges of a range, so rows of a repeated key don't remove
each other's words, and one key may have any number of rows.

Files are written under names of their own and count once Spark has committed the
row that names them, so a lost or repeated task leaves an orphan at most.

Defined results: a null or empty text has no words; rows of null key are neither
removed from nor counted as earlier, and a key of -2**63 is held as null; repeated
rows and ties (equal keys) leave each other alone; a very long text may fill a
block of its own; extra columns, of whatever name, are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan.llm.common import bounded_batches, raw
from veldspan.workspace import Workspace, remove

WIDTH = 13
#: Text bytes of a block, windows of a shard, batches until a shard's turn to be compacted.
BLOCK_BYTES, SHARD_WINDOWS, FANOUT = 8 << 20, 2 << 20, 4
#: Entries of a run file that are read at once.
CHUNK = 1 << 18
NULL_KEY = -(1 << 63)
_BLOCKS = {"block": pa.int64(), "rank": pa.int64(), "n_windows": pa.int64(), "keys": pa.binary(), "sizes": pa.binary(), "words": pa.binary(), "vocabulary": pa.binary()}
_HISTORY = -1
_TOP = np.uint64(2**64 - 1)


def _ddl(fields: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{k} {names[t]}" for k, t in fields.items())


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _rolling(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive word hashes: a polynomial, put together from windows of 1, 2, 4 ... words."""
    power = (0x9E3779B97F4A7C15 ^ (seed << 1)) & (2**64 - 1) | 1
    part, size = _mix(words + np.uint64(seed)), 1
    out, held = None, 0
    while True:
        if width & size:
            n = len(words) - held - size + 1
            out = part if out is None else out[:n] * np.uint64(power) + part[held : held + n]
            held += size
        if held == width:
            return _mix(out)
        n = len(part) - size
        part = part[:n] * np.uint64(power) + part[size : size + n]
        power = power * power & (2**64 - 1)
        size *= 2


class Windows:
    """All windows of a block, and its distinct hashes in order."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, vocabulary: list[bytes], width: int):
        self.keys, self.sizes, self.ids, self.vocabulary, self.width = keys, sizes, ids, vocabulary, width
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, vocabulary)), "<u8").reshape(-1, 2)
        n = len(ids)
        doc = np.repeat(np.arange(len(keys)), sizes)
        if n >= width:
            self.at = np.flatnonzero((doc[width - 1 :] == doc[: n - width + 1]) & (keys[doc[: n - width + 1]] != NULL_KEY))
            h = _rolling(both[:, 0][ids], width, 1)[self.at]
            self.prints = (_rolling(both[:, 1][ids], width, 2)[self.at] >> np.uint64(48)).astype(np.uint16)
        else:
            self.at, h, self.prints = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        self.key = keys[doc[self.at]]
        self.order = np.argsort(h)
        h = h[self.order]
        self.new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        starts = np.flatnonzero(self.new)
        self.first = np.minimum.reduceat(self.order, starts) if len(starts) else starts  # of each distinct hash, the window of the smallest key
        self.distinct = h[self.new]

    def groups(self) -> np.ndarray:
        """Of each window, the number of its distinct hash."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new) - 1
        return out


def pack(run: np.ndarray) -> bytes:
    """Sorted integers as their first and differences, in as few bytes each as the largest needs; byte by byte, as the leading ones are alike."""
    if not len(run):
        return b""
    gaps = np.diff(run)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    body = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + int(run[0]).to_bytes(8, "little") + body


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    gaps = np.zeros((body.shape[1] + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(data, np.uint8, 8, 1)
    gaps[1:, :width] = body.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def write_run(uri: str, hashes: np.ndarray, prints: np.ndarray) -> None:
    """A run file: chunks of packed hashes and their fingerprints, then a directory of the chunks."""
    files, path = fs.FileSystem.from_uri(uri)
    zip_, at, where = zstandard.ZstdCompressor(level=1), 0, []
    with files.open_output_stream(path) as f:
        for a in range(0, len(hashes), CHUNK):
            h = zip_.compress(pack(hashes[a : a + CHUNK]))
            data = struct.pack("<Q", len(h)) + h + prints[a : a + CHUNK].astype("<u2").tobytes()
            f.write(data)
            where += [int(hashes[a]), at, len(data)]
            at += len(data)
        f.write(np.array(where, "<u8").tobytes() + struct.pack("<QQ", at, len(where) // 3))


def read_run(uri: str, low: np.uint64, high: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The entries of a run from ``low`` to ``high``, a chunk at a time."""
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 16)
        at, n = struct.unpack("<QQ", f.read(16))
        f.seek(at)
        where = np.frombuffer(f.read(24 * n), "<u8").reshape(-1, 3)
        a = max(0, int(np.searchsorted(where[:, 0], low)) - 1)  # hashes equal to low may begin in the chunk before
        for _, begin, length in where[a : int(np.searchsorted(where[:, 0], high, "right"))].tolist():
            f.seek(begin)
            data = f.read(length)
            (m,) = struct.unpack_from("<Q", data)
            h, s = unpack(zstandard.ZstdDecompressor().decompress(data[8 : 8 + m])), np.frombuffer(data, "<u2", offset=8 + m)
            x, z = np.searchsorted(h, low), np.searchsorted(h, high, "right")
            if x < z:
                yield h[x:z], s[x:z]


def held(hashes: np.ndarray, prints: np.ndarray, run: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which of the sorted ``hashes`` a run holds with the same fingerprint."""
    out = np.zeros(len(hashes), bool)
    for h, s in run:
        a, z = np.searchsorted(hashes, h[0]), np.searchsorted(hashes, h[-1], "right")
        at = np.searchsorted(h, hashes[a:z])
        todo = np.arange(len(at))
        while len(todo):  # once, but for entries of equal hash and different fingerprints
            todo = todo[(at[todo] < len(h))]
            todo = todo[h[at[todo]] == hashes[a:z][todo]]
            out[a + todo[s[at[todo]] == prints[a:z][todo]]] = True
            at[todo] += 1
    return out


def _bounds(shard: int, bits: int) -> tuple[np.uint64, np.uint64]:
    low = shard << (64 - bits)
    return np.uint64(low), np.uint64(low + (1 << (64 - bits)) - 1)


def _cut_into_blocks(keys: np.ndarray, sizes: np.ndarray, block_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows: the first and last key by themselves, the rest cut between keys; one large key is cut anywhere."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    a, held = 0, 0
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        size = int(sizes[s:e].sum())
        alone = k in (0, len(starts) - 1) or size > block_bytes
        if held and (alone or held + size > block_bytes):
            yield a, s
            a, held = s, 0
        if alone:
            while s < e:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[s:e]), block_bytes)))
                yield s, min(e, s + n)
                s += n
            a, held = e, 0
        else:
            held += size
    if a < len(keys):
        yield a, len(keys)


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _packed(keys: np.ndarray, texts: list[bytes], width: int) -> list:
    """``n_windows, keys, sizes, words, vocabulary`` of a block."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(texts))
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.uint32, int(sizes.sum()))
    zip_ = zstandard.ZstdCompressor(level=1)
    windows = int(np.maximum(sizes - width + 1, 0).sum())
    return [windows, keys.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), zip_.compress(_planes(ids, 4)), zip_.compress(b" ".join(number))]


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    unzip = zstandard.ZstdDecompressor().decompress
    ids = np.ascontiguousarray(np.frombuffer(unzip(row["words"]) if row["words"] else b"", np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["sizes"], "<i8"), ids, unzip(row["vocabulary"]).split()


def _blocks(docs: DataFrame, key: str, text: str, width: int, block_bytes: int) -> DataFrame:
    """Rows of packed documents, in ascending key order."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), F.col(text).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0

        def block(keys: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal n
            row = [(part << 32) + n, int(keys[0]), *_packed(keys, texts, width)]
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCKS.values(), strict=True)], list(_BLOCKS))

        keys, texts, held = np.zeros(0, np.int64), [], 0
        for b in batches:
            new = raw(b.column(1))
            keys, texts, held = np.concatenate([keys, b.column(0).to_numpy()]), texts + new, held + sum(map(len, new))
            if held > 3 * block_bytes:
                ranges = list(_cut_into_blocks(keys, np.fromiter(map(len, texts), np.int64, len(texts)), block_bytes))
                # the last key may go on, so it waits, and what was cut before it goes out
                stop = int(np.searchsorted(keys, keys[-1]))
                if stop == 0:  # one key only: whole blocks of it can go
                    stop = ranges[-1][0]
                out = [(a, z) for a, z in ranges if z <= stop]
                for a, z in out:
                    yield block(keys[a:z], texts[a:z])
                done = out[-1][1] if out else 0
                keys, texts = keys[done:], texts[done:]
                held = sum(map(len, texts))
        if len(keys):
            for a, z in _cut_into_blocks(keys, np.fromiter(map(len, texts), np.int64, len(texts)), block_bytes):
                yield block(keys[a:z], texts[a:z])

    return own.mapInArrow(run, _ddl(_BLOCKS))


def _each_block(table: DataFrame, width: int, each, schema: str) -> DataFrame:
    """``each(row, windows)`` yields record batches for one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}
                yield from each(row, Windows(*_unpacked(row), width))

    return table.mapInArrow(run, schema)


_REQUEST = {"shard": pa.int64(), "block": pa.int64(), "rank": pa.int64(), "hashes": pa.binary(), "prints": pa.binary()}


def _requests(table: DataFrame, width: int, bits: int) -> DataFrame:
    """What blocks send to shards: their distinct windows."""

    def each(row: dict, w: Windows) -> Iterator[pa.RecordBatch]:
        shards = (w.distinct >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.zeros(0, np.int64)
        if not len(starts):
            return
        prints, n = w.prints[w.first], len(starts)
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(shards)], strict=True))
        columns = shards[starts].tolist(), [row["block"]] * n, [row["rank"]] * n, [pack(w.distinct[a:z]) for a, z in spans], [prints[a:z].astype("<u2").tobytes() for a, z in spans]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _REQUEST.values(), strict=True)], list(_REQUEST))

    return _each_block(table, width, each, _ddl(_REQUEST))


def _in_order(hashes: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The order by hash and fingerprint, earlier ones first among equals."""
    order = np.argsort(hashes, kind="stable")
    h, s = hashes[order], prints[order]
    if ((h[1:] == h[:-1]) & (s[1:] != s[:-1])).any():
        order = np.lexsort((prints, hashes))
    return order


def _distinct(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])] if len(h) else np.zeros(0, bool)


_MERGED = "shard long, block long, mask binary, file string, n long"


def _merge(requests: DataFrame, bits: int, folder: str | None) -> DataFrame:
    """Replies ``(shard, block, mask)``, and a shard's new run as a row without a block: a merge-join of a shard's runs."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, past = int(pdf["shard"].iloc[0]), pdf["block"] == _HISTORY
        names, now = pdf.loc[past, "file"].tolist(), pdf[~past].sort_values(["rank", "block"], kind="stable")
        out = []
        if len(now):
            runs = [unpack(x) for x in now["hashes"]]
            sizes = np.fromiter(map(len, runs), np.int64, len(runs))
            h, s = np.concatenate(runs), np.concatenate([np.frombuffer(x, "<u2") for x in now["prints"]])
            rank = np.repeat(now["rank"].to_numpy(), sizes)
            del runs
            order = _in_order(h, s)
            h, s, rank = h[order], s[order], rank[order]
            new = _distinct(h, s)
            starts = np.flatnonzero(new)
            old = np.zeros(len(starts), bool)
            for name in names:
                old |= held(h[starts], s[starts], read_run(name, *_bounds(shard, bits)))
            group = np.cumsum(new) - 1
            later = np.empty(len(h), bool)
            later[order] = old[group] | (rank > rank[starts][group])
            ends = np.cumsum(sizes)
            for block, z, n in zip(now["block"], ends.tolist(), sizes.tolist(), strict=True):
                if later[z - n : z].any():
                    out.append((shard, block, np.packbits(later[z - n : z]).tobytes(), None, None))
            if folder and not old.all():
                name = f"{folder}/{shard}-{uuid.uuid4().hex}.run"
                write_run(name, h[starts][~old], s[starts][~old])
                out.append((shard, _HISTORY, None, name, int((~old).sum())))
        return pd.DataFrame(out, columns=["shard", "block", "mask", "file", "n"])

    return requests.groupBy("shard").applyInPandas(merge, _MERGED)


def _compact(runs: DataFrame, bits: int, folder: str) -> DataFrame:
    """Merge a shard's runs into one."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        parts = [x for name in pdf["file"] for x in read_run(name, *_bounds(shard, bits))]
        if not parts:
            return pd.DataFrame([], columns=["shard", "file", "n"])
        h, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = _in_order(h, s)
        h, s = h[order], s[order]
        new = _distinct(h, s)
        name = f"{folder}/{shard}-{uuid.uuid4().hex}.run"
        write_run(name, h[new], s[new])
        return pd.DataFrame([(shard, name, int(new.sum()))], columns=["shard", "file", "n"])

    return runs.groupBy("shard").applyInPandas(merge, "shard long, file string, n long")


class SubstringIndex:
    """Runs of the windows of past batches; ``dedup`` judges a batch against them and itself."""

    def __init__(self, spark: SparkSession, *, width: int = WIDTH, shard_windows: int = SHARD_WINDOWS, block_bytes: int = BLOCK_BYTES):
        self.spark, self.width, self.shard_windows, self.block_bytes = spark, width, shard_windows, block_bytes
        self.ws = Workspace(spark, "substrings")
        self.folder = f"{self.ws.path}/runs"
        files, path = fs.FileSystem.from_uri(self.folder)
        files.create_dir(path, recursive=True)
        #: ``shard, file, n`` of each run: a line for some millions of windows.
        self.runs: DataFrame | None = None
        self.bits, self._batch, self._windows = 3, 0, 0

    def dedup(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", add: bool = True) -> DataFrame:
        """``key, n_words, n_removed, kept_text`` of each row; ``add`` puts the batch into the index."""
        self._batch += 1
        k, ws, width = self._batch, self.ws, self.width
        kind = docs.schema[key].dataType.simpleString()
        table = ws.save(_blocks(docs, key, text, width, self.block_bytes), f"blocks{k}")
        total = table.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]
        self._split(max(3, int(np.ceil(np.log2(max(1, total + self._windows) / self.shard_windows)))))
        bits = self.bits
        requests = _requests(table, width, bits).withColumn("file", F.lit(None).cast("string"))
        if self.runs is not None:
            past = self.runs.select("shard", F.lit(_HISTORY).cast("long").alias("block"), F.lit(NULL_KEY).alias("rank"), F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("prints"), "file")
            requests = requests.unionByName(past)
        merged = ws.save(_merge(requests, bits, self.folder if add else None), f"merged{k}")
        if add:
            self._windows += total
            new = merged.where(f"block = {_HISTORY}").select("shard", "file", "n")
            self.runs = ws.save(new if self.runs is None else self.runs.unionByName(new), f"runs{k}")
            self._compacted(k)
        replies = merged.where(f"block <> {_HISTORY}").groupBy("block").agg(F.collect_list(F.struct("shard", "mask")).alias("replies"))  # one for each shard at most
        out = _each_block(table.join(replies, "block", "left"), width, lambda row, w: _apply(row, w, bits), "key long, n_words long, n_removed long, kept_text string")
        return out.select(F.nullif("key", F.lit(NULL_KEY)).cast(kind).alias(key), "n_words", "n_removed", "kept_text")

    def _split(self, bits: int) -> None:
        """More shards: each new one reads its range of the runs of the one it was cut from."""
        more = bits - self.bits
        if more <= 0:
            return
        if self.runs is not None:
            children = F.expr(f"sequence(shard * {1 << more}, shard * {1 << more} + {(1 << more) - 1})")
            self.runs = self.runs.withColumn("shard", F.explode(children))
        self.bits = bits

    def _compacted(self, k: int) -> None:
        """Compact the shards whose turn it is; files that no shard reads any more go."""
        many = self.runs.where(F.col("shard") % FANOUT == k % FANOUT).groupBy("shard").agg(F.count("*").alias("runs")).where("runs > 1").select("shard")
        turn = self.ws.save(self.runs.join(many, "shard", "left_semi"), f"turn{k}")
        if turn.isEmpty():
            return
        new = _compact(turn, self.bits, self.folder)
        self.runs = self.ws.save(self.runs.join(many, "shard", "left_anti").unionByName(new), f"compacted{k}")
        for row in turn.select("file").distinct().join(self.runs, "file", "left_anti").toLocalIterator():
            remove(self.spark, row["file"])

    def drop(self) -> None:
        """Remove the index and all that results of ``dedup`` are read from."""
        self.ws.drop()


def _apply(row: dict, w: Windows, bits: int) -> Iterator[pa.RecordBatch]:
    """Remove the words of windows that started before: in another block, or in this one in a smaller key."""
    flags = np.zeros(len(w.distinct), bool)
    for r in row["replies"] or ():
        low, high = _bounds(r["shard"], bits)
        a, z = np.searchsorted(w.distinct, low), np.searchsorted(w.distinct, high, "right")
        flags[a:z] = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=z - a)
    group = w.groups()
    first = w.first[group]
    bad = w.at[(w.prints == w.prints[first]) & (flags[group] | (w.key > w.key[first]))]
    n = len(w.ids)
    edge = np.zeros(n + 1, np.int32)
    edge[bad] += 1  # windows begin at distinct words
    edge[np.minimum(bad + w.width, n)] -= 1
    keep = np.cumsum(edge[:n]) == 0
    words = map(w.vocabulary.__getitem__, w.ids.tolist())
    ends = np.cumsum(w.sizes)
    kept, removed = [], []
    for z, size in zip(ends.tolist(), w.sizes.tolist(), strict=True):
        mine = keep[z - size : z]
        removed.append(size - int(mine.sum()))
        own = [next(words) for _ in range(size)]
        kept.append(b" ".join(compress(own, mine.tolist()) if removed[-1] else own).decode())
    columns = [pa.array(w.keys), pa.array(w.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
    yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_removed", "kept_text"])
