"""Operator 3 for whole documents: near-dedup by resemblance of their word shingles.

SimHash alone can't do it: at a similarity of 0.8 fingerprints of 64 bits differ in
ten bits on average, far beyond any radius that blocks can key.  So candidates come
from minimum hashes too, and whole sets decide.

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is at least 0.8, computed on the whole sets, or if their SimHash
fingerprints are linked (``simhash``).  Sets that share one of 32 bands of 5 minimum
hashes with another are candidates: at a similarity of 0.8 a pair shares none with
a chance of 3 in a million, above it with less.

Which candidates to compare, an index of their rarest shingles tells (prefix and
positions, Xiao et al., WWW 2008).  Sets of ``n`` and ``m`` shingles are similar only
if they share ``4 (n + m) / 9`` of them, so the rarest that they share has at least
as many from it on in either set.  Texts that grew out of one text differ from it in
rare shingles, so a large family whose members aren't similar hardly meets in the
index.  Each shingle's sets are first compared with the one that has least before
it; what that links needs no more comparing.  Then all pairs that meet across
components are compared, however many: nothing is capped or left to chance.
Entries are keyed by sizes as well, so a bucket holds what may fit.

Words are split and lowered as in ``simhash``; a text of fewer words than a shingle
has one shingle.  Documents of equal sets are one node.

Defined results: null and empty texts have the empty set and are linked to each
other; repeated rows are linked; of equal keys the first row stays, and a row of null
key only if its group has no other; a very long text is compared whole; extra columns
pass by untouched; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspan.components import connected_components
from veldspan.llm import simhash
from veldspan.llm.common import arrow_map, batch, joined_words, numbered, raw
from veldspan.workspace import Workspace

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
#: Sizes of one class of the index differ by this factor at most.
WIDTH = 1.05
#: Shingles that are hashed at once, so that a long text takes no more memory.
_AT_ONCE = 4096
_SEEDS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    joined, starts, ends = joined_words(text.lower())
    if not joined:
        return np.zeros(0, np.uint64)
    k, digest = min(shingle, len(starts)), xxhash.xxh3_64_intdigest
    spans = zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:z]) for a, z in spans), np.uint64, len(starts) - k + 1))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of the minimum hashes; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, ((hashes[a : a + _AT_ONCE] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _ODD
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, fp, sid, n, bands``; ``sid`` stands for the set of shingles."""
    kind = docs.schema[key].dataType.simpleString()

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(b.column(1))
        sets = [shingles(t) for t in texts]
        fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        sid = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        return batch(key=b.column(0), fp=pa.array(fp), sid=pa.array(sid), n=pa.array([len(s) for s in sets], pa.int64()), bands=pa.array([bands(s) for s in sets], pa.list_(pa.int64())))

    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), each, f"key {kind}, fp long, sid long, n long, bands array<long>")


def _sets(rows: DataFrame, text: str) -> DataFrame:
    """``sid, hashes`` of rows with their ``sid``."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(sid=b.column(0), hashes=pa.array([shingles(t).astype("<u8").tobytes() for t in raw(b.column(1))], pa.binary()))

    return arrow_map(rows.select("sid", text), each, "sid long, hashes binary")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have at least the similarity ``LEAST``."""
    left = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
            keep.append(5 * both >= 4 * (len(x) // 8 + len(y) // 8 - both))
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), each, "a long, b long")


def _candidates(table: DataFrame, ws: Workspace) -> DataFrame:
    """``sid`` of the sets that share a band with another."""
    members = table.where("n > 0").groupBy("sid").agg(F.first("bands").alias("bands")).select("sid", F.explode("bands").alias("h"))
    shared = members.groupBy("h").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi")
    return ws.save(members.join(shared, "h", "left_semi").select("sid").distinct(), "candidates")


def _index(sets: DataFrame, ws: Workspace) -> DataFrame:
    """``t, sid, n, rest``: the shingles that may be the rarest which a set of ``n`` shares with a similar one; ``rest`` are as frequent or more, itself included."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
        n = [len(x) for x in hashes]
        return batch(sid=pa.array(np.repeat(b.column(0).to_numpy(), n)), n=pa.array(np.repeat(n, n), pa.int64()), t=pa.array(np.concatenate(hashes)))

    shingle = arrow_map(sets.select("sid", "hashes"), each, "sid long, n long, t long")
    common = shingle.groupBy("t").agg(F.count("*").alias("sets")).where("sets > 1")  # those of one set are the rarest, and lead to none
    rest = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("sets"), F.desc("t"))).cast("long")
    return ws.save(shingle.join(common, "t").select("t", "sid", "n", rest.alias("rest")).where("(4 * n + 4) div 5 <= 9 * rest div 4 - n"), "index")


def _fits(n: str, rest: str, m: str, far: str) -> Column:
    """The positions of a shared shingle allow the similarity, if it is the rarest that is shared."""
    return 4 * (F.col(n) + F.col(m)) <= 9 * F.least(rest, far)


def _stars(index: DataFrame, ws: Workspace) -> DataFrame:
    """Pairs ``(a, b)`` of each shingle's sets with the one that has least before it."""
    ends = index.groupBy("t").agg(F.max(F.struct((F.col("rest") / F.col("n")).alias("share"), "sid", "n", "rest")).alias("e"))
    met = index.join(ends, "t").where("sid <> e.sid").where(_fits("n", "rest", "e.n", "e.rest"))
    return ws.save(met.select(F.least("sid", "e.sid").alias("a"), F.greatest("sid", "e.sid").alias("b")).distinct(), "stars")


def _across(index: DataFrame, parts: DataFrame, ws: Workspace) -> DataFrame:
    """All pairs ``(a, b)`` of different components that meet in the index."""
    named = ws.save(_named(index, parts, "sid"), "named")
    sizes = named.groupBy("t", "part").agg(F.count("*").alias("k")).groupBy("t").agg(F.max(F.struct("k", "part")).alias("most"), F.count("*").alias("parts"))
    size_class = lambda n: F.floor(F.log(F.expr(n)) / F.log(F.lit(WIDTH))).cast("int")
    fitting = F.sequence(size_class("(4 * n + 4) div 5"), size_class("least(5 * n div 4, 9 * rest div 4 - n)"))
    rows = named.join(sizes.where("parts > 1"), "t").select("t", "sid", "n", "rest", "part", F.expr("part = most.part").alias("largest"), size_class("n").alias("own"), F.explode(fitting).alias("to"))
    rows = ws.save(rows, "several")
    # a shingle's largest component isn't compared with itself
    left = rows.where("NOT largest").select("t", "own", "to", F.col("sid").alias("a"), "n", "rest", "part")
    right = rows.select("t", F.col("to").alias("own"), F.col("own").alias("to"), F.col("sid").alias("b"), F.col("n").alias("m"), F.col("rest").alias("far"), F.col("part").alias("other"), "largest")
    met = left.join(right, ["t", "own", "to"]).where("part <> other AND (largest OR a < b)").where(_fits("n", "rest", "m", "far"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_fingerprint(table: DataFrame, ws: Workspace) -> DataFrame:
    """``(a, b)``: sets whose texts have linked fingerprints, as a spanning forest."""
    own = ws.save(table.select("fp", "sid").distinct(), "fingerprints")
    least = own.groupBy("fp").agg(F.min("sid").alias("b"))
    same = own.join(least, "fp").select(F.col("sid").alias("a"), "b").where("a <> b")
    found = ws.save(simhash.links(simhash.buckets(own.select("fp").distinct(), ws)), "fingerprint_links")
    other = found.join(least, "fp").select("root", F.col("b").alias("a")).join(least.withColumnRenamed("fp", "root"), "root").select("a", "b").where("a <> b")
    return ws.save(same.unionByName(other), "by_fingerprint")


def _named(nodes: DataFrame, parts: DataFrame, column: str) -> DataFrame:
    """``nodes`` with ``part``: the component of ``column``, or itself."""
    return nodes.join(parts.select(F.col("node").alias(column), "component"), column, "left").select(*nodes.columns, F.coalesce("component", column).alias("part"))


def groups(table: DataFrame, rows: DataFrame, text: str, ws: Workspace) -> DataFrame:
    """``sid, part`` of the sets that are linked to others; only texts with a candidate are read again."""
    one = table.join(_candidates(table, ws), "sid", "left_semi").groupBy("sid").agg(F.min("key.row").alias("__row"))
    sets = ws.save(_sets(rows.join(ws.save(one, "one"), "__row"), text), "sets")
    index = _index(sets, ws)
    stars = _stars(index, ws)
    links = _by_fingerprint(table, ws).unionByName(ws.save(_similar(stars, sets), "links"))
    parts = ws.save(connected_components(links, "a", "b"), "parts")
    across = _across(index, parts, ws).join(stars, ["a", "b"], "left_anti")
    more = ws.save(_similar(ws.save(across, "across"), sets), "more")
    own = parts.select(F.col("node").alias("sid"), "component")
    if more.isEmpty():
        return own.withColumnRenamed("component", "part")
    # components of components: a graph of the new links alone
    a = _named(more, parts, "a").select("b", F.col("part").alias("x"))
    met = connected_components(_named(a, parts, "b").select("x", F.col("part").alias("y")), "x", "y")
    ends = more.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    every = own.unionByName(ends.join(own, "sid", "left_anti").withColumn("component", F.col("sid")))
    to = met.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return every.join(to, "component", "left").select("sid", F.coalesce("to", "component").alias("part"))


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each linked group: that of the smallest key, then of the first row; null keys last."""
    ws = Workspace(docs.sparkSession, "resemblance")
    rows = numbered(docs, ws)
    order = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col("__row").alias("row"))
    table = ws.save(_sketches(rows.select(order.alias("k"), F.col(text).alias("t")), "k", "t"), "sketches")
    named = table.select("key", "sid").join(groups(table, rows, text, ws), "sid", "left")
    named = ws.save(named.select("key", F.coalesce("part", "sid").alias("part")), "groups")
    stays = named.groupBy("part").agg(F.min("key").alias("first"))
    gone = ws.save(named.join(stays, "part").where("key <> first").select(F.col("key.row").alias("__row")), "gone")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
