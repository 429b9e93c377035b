"""SimHash near-dedup with bit-sliced comparison.

Fingerprints within ``radius`` 2 agree on two of four 16-bit blocks, so the six
pairs of blocks key all candidates.  A bucket that outgrows ``MOST`` is keyed
anew by the bits it doesn't share: four bytes of the other 32 bits, then four
nibbles of the other 16, with the same argument each time, which ends at buckets
of at most 256 different fingerprints.  No pair is lost and no bucket is large.

Fingerprints are stored vertically, a bit plane for each bit, with all buckets of
a batch, small and large, side by side.  The planes meet themselves moved by 1, 2,
3 ... lanes: the distances of all rows to the next, second next ... of their bucket
are counted at once by carry-save counters of two bits, and a block of lanes is
abandoned once all of its distances exceed the radius.  A bucket yields a spanning
star of each linked set rather than its pairs.

Equal fingerprints are one node, however many documents share one.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; repeated rows are linked; rows of null key take part but never name a
component; a component of null keys alone has a null id; of equal keys and of ties the
smallest key names; a very long text is hashed in pieces; extra columns, of whatever
name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.components import connected_components
from veldspan.llm.common import arrow_map, batch, bounded_batches, joined_words, numbered, raw
from veldspan.workspace import Workspace

#: Fingerprints of a bucket, at most.
MOST = 2048
RADIUS = 2
#: Shingles that are hashed, words of 64 lanes that are compared, and pairs that are held at once.
AT_ONCE, BLOCK_WORDS, FOLD = 1 << 16, 256, 1 << 20
_FULL = np.uint64(2**64 - 1)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    joined, starts, ends = joined_words(text.lower())  # bytes.lower() changes A-Z only
    if not joined:
        return 0
    n = max(1, len(starts) - shingle + 1)
    ends, digest, ones = ends[min(shingle, len(ends)) - 1 :], xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, AT_ONCE):
        spans = zip(starts[a : min(n, a + AT_ONCE)].tolist(), ends[a : a + AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(joined[x:z], seed) for x, z in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """``(key, fp)``; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in raw(b.column(1))], np.uint64).view(np.int64)
        return batch(key=b.column(0), fp=pa.array(fp))

    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), each, f"key {kind}, fp long")


def _halves(free: list[int]) -> list[int]:
    """Masks of the six choices of two of four equal runs of the free bits."""
    k = len(free) // 4
    runs = [sum(1 << b for b in free[i * k : (i + 1) * k]) for i in range(4)]
    return [a | b for a, b in combinations(runs, 2)]


def _masks(levels: int = 3) -> list[list[int]]:
    """For each level the masks of all its keys; those of mask ``c`` are ``6 c .. 6 c + 5`` one level on."""
    out, before = [], [0]
    for _ in range(levels):
        before = [m | x for m in before for x in _halves([b for b in range(64) if not m >> b & 1])]
        out.append(before)
    return out


MASKS = _masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(nodes: DataFrame, ws: Workspace, most: int = MOST) -> DataFrame:
    """``(level, combo, masked, fp)`` of all buckets of 2 to ``most`` fingerprints."""
    masks = F.array(*(F.lit(_signed(m)) for m in MASKS[0]))
    rows = nodes.select("fp", F.posexplode(masks).alias("combo", "mask")).select("fp", "combo", F.col("fp").bitwiseAND(F.col("mask")).alias("masked"))
    out = None
    for level in range(len(MASKS)):
        counts = rows.groupBy("combo", "masked").agg(F.count("*").alias("n"))
        rows = ws.save(rows.join(counts.where("n > 1"), ["combo", "masked"]), f"level{level}")
        last = level + 1 == len(MASKS)
        done = (rows if last else rows.where(F.col("n") <= most)).select(F.lit(level).alias("level"), "combo", "masked", "fp")
        out = done if out is None else out.unionAll(done)
        if last or rows.where(F.col("n") > most).limit(1).count() == 0:
            break
        children = F.array(*(F.array(*(F.lit(_signed(m)) for m in MASKS[level + 1][6 * c : 6 * c + 6])) for c in range(len(MASKS[level]))))
        hot = rows.where(F.col("n") > most).select("fp", "combo", F.posexplode(F.element_at(children, F.col("combo") + 1)).alias("i", "mask"))
        rows = hot.select("fp", (F.col("combo") * 6 + F.col("i")).alias("combo"), F.col("fp").bitwiseAND(F.col("mask")).alias("masked"))
    return out


def _packed(flags: np.ndarray) -> np.ndarray:
    """Flags along the last axis as bits of 64-bit words, with words of zeros behind."""
    n = flags.shape[-1]
    pad = [(0, 0)] * (flags.ndim - 1) + [(0, -n % 64 + 64)]
    return np.packbits(np.pad(flags, pad), axis=-1, bitorder="little").view("<u8")


def _within(planes: np.ndarray, off: int, same: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Lanes ``i`` in which rows ``i`` and ``i + off`` are within the radius, of those marked in ``same``.

    All lanes of a block are compared at once, plane by plane: counters of two bits
    take the differing bits by carry-save additions, and ``over`` keeps the lanes
    that have left the radius.  A block is abandoned once no lane is left.
    """
    words, bits = divmod(off, 64)
    for a in range(0, len(same), BLOCK_WORDS):
        near = same[a : a + BLOCK_WORDS]
        z = a + len(near)
        if not near.any():
            continue
        other = planes[:, a + words : z + words]
        if bits:
            other = other >> np.uint64(bits) | planes[:, a + words + 1 : z + words + 1] << np.uint64(64 - bits)
        ones = np.zeros(len(near), np.uint64)
        twos, over = ones.copy(), ~near
        for k, differ in enumerate(planes[:, a:z] ^ other):
            carry = ones & differ
            ones = ones ^ differ
            over |= twos & carry
            twos = twos ^ carry
            if radius < 3:
                over |= ones & twos
            if k % 8 == 7 and (over == _FULL).all():
                break
        else:
            bad = over if radius >= 2 else over | twos if radius == 1 else over | twos | ones
            lanes = np.flatnonzero(np.unpackbits(np.ascontiguousarray(~bad).view(np.uint8), bitorder="little"))
            if len(lanes):
                yield 64 * a + lanes


def within_radius(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(i, j)`` of rows of one group within the radius (2 at most); groups adjoin, of whatever sizes.

    Bit planes hold all groups side by side.  The planes, moved by 1, 2, 3 ... lanes,
    meet themselves, so each step compares every row with one more of its group.
    """
    rows = np.arange(len(fps))
    off, again = 1, 1
    while True:
        if off == again:  # leave out the groups that have no pair this far apart
            again *= 2
            sizes = np.unique(groups[rows], return_inverse=True, return_counts=True)
            rows = rows[sizes[2][sizes[1]] > off] if len(rows) else rows
            if not len(rows):
                return
            own, bits = groups[rows], np.unpackbits(fps[rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            planes = np.pad(_packed(np.ascontiguousarray(bits.T)), ((0, 0), (0, (again >> 6) + 2)))
        same = own[off:] == own[:-off]
        if not same.any():
            return
        for i in _within(planes, off, _packed(same)[:-1], radius):
            yield rows[i], rows[i + off]
        off += 1


def _stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``(row, root)`` of the linked sets of rows; pairs are folded as they come, so they needn't be held."""

    def folded(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = np.arange(n)
        while True:  # smallest reachable row
            before = label.copy()
            np.minimum.at(label, j, label[i])
            np.minimum.at(label, i, label[j])
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(n))
        return moved, label[moved]

    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size > FOLD:
            held = [folded(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = 0
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return folded(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _links(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of all buckets of sorted rows; ``groups`` numbers them."""
    row, root = _stars(len(fps), within_radius(fps.view(np.uint64), groups, radius))
    return fps[row], fps[root]


def links(groups: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)``: each bucket's stars; buckets arrive whole and sorted."""
    bounded_batches(groups.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            table = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            table = table if kept is None else np.concatenate([kept, table], axis=1)
            if not table.shape[1]:
                continue
            new = np.r_[True, (table[:3, 1:] != table[:3, :-1]).any(0)]
            at = int(np.flatnonzero(new)[-1])  # the last bucket may go on
            kept = table[:, at:]
            if at:
                yield out(np.cumsum(new[:at]), table[3, :at])
        if kept is not None and kept.shape[1] > 1:
            yield out(np.zeros(kept.shape[1], np.int64), kept[3])

    def out(numbers: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _links(numbers, np.ascontiguousarray(fps), radius)
        return batch(fp=pa.array(a), root=pa.array(b))

    keys = ["level", "combo", "masked"]
    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "fp long, root long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """``key, fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable."""
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0, 1 or 2")
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.save(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = ws.save(rows.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    found = ws.save(links(buckets(nodes.select("fp"), ws, most), radius), "links")
    parts = connected_components(found, "fp", "root")
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = ws.save(named, "named")
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.select("fp", "component").join(ids, "component").select("fp", "component_id")
    out = rows.join(by_fp, "fp")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of ``docs`` of each linked group: that of the smallest key, then of the first row; null keys last."""
    ws = Workspace(docs.sparkSession, "simhash-dedup")
    rows = numbered(docs, ws)
    order = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col("__row").alias("row"))
    found = near_duplicates(rows.select(order.alias("k"), F.col(text).alias("t")), key="k", text="t", **how)
    gone = ws.save(found.where("k <> component_id").select(F.col("k.row").alias("__row")), "gone")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
