"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's token budget is reached by complete epochs first; what remains is
a weighted sample without replacement: documents sorted by exponential keys
``-ln(u) / weight`` (``u`` a hash of key and text, ``weight`` the document's
quality), taken while at least half of the next one fits the prefix sum's budget.
So a source ends within half a document of its target.

A source may hold most rows, so no window spans a source.  Keys fall into buckets
of one relative width, 2**(1/1024): whatever the weights, at most a part in e * 1477
of a source's documents is expected in one.  Sums by (source, bucket) are
pre-aggregated and cumulated, and only within one bucket are rows ordered.

Defined results: a null text has size 0 and weight as an empty one; null source
is a source (last in order); repeated rows are counted before they are ordered
and come back as rows of their own, of which the budget may select some; ties
(equal exponential keys) go in order of document key and size; null keys are hashed as
the empty key; a very long text counts whole; an empty table gives no rows; extra
columns, of whatever name, are not read or, in ``mixed``, pass by untouched.  Of a
source without words nothing is taken, and a source whose epochs meet its target
selects nothing more, not even empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspan.llm.common import WORD, row_id, scanned
from veldspan.workspace import Workspace

#: Buckets of the exponential keys to each doubling.
BUCKETS = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """In [0.05, 1]: the share of the text's characters that aren't symbols or digits, in 20ths."""
    odd = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>0-9]")), F.lit(0))
    n = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))
    return F.greatest(F.floor(20 - 20 * odd / n), F.lit(1)) / F.lit(20.0)


def targets(sources: DataFrame, source: str, size: str, weights: tuple[int, ...], share_percent: int, most: int) -> DataFrame:
    """Adds ``target``: water-filling of ``share_percent`` of all sizes over the sources.

    Sources in code point order (null last) have ``weights`` in turn.  Sharing
    by weight up to a cap and resharing the excess ends at one level: sources
    are capped in order of ``cap / weight``, so the level is found by prefix
    sums.  One row for each source of the mix, far fewer than documents.
    Totals are summed as integers; one division gives each target.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    turn = F.array(*map(F.lit, weights))
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    # capped before this one: those with a smaller cap for each unit of weight
    w = Window.orderBy(F.col(size) / F.col("weight"), "rank")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest_weight = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum(size).over(everything)
    ranked = ranked.select("*", before.alias("_before"), rest_weight.alias("_rest"), total.alias("_total"))
    # level = (share * total - most * capped) / rest_weight; this source is capped if most * size <= weight * level
    left = F.col("_total") * share_percent - F.col("_before") * (100 * most)
    capped = F.col(size) * (100 * most) * F.col("_rest") <= F.col("weight") * left
    ranked = ranked.withColumn("_capped", capped)
    n_capped = F.sum(F.when(F.col("_capped"), F.col(size)).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("weight"))).over(everything)
    level_up = F.col("weight") * (F.col("_total") * share_percent - n_capped * (100 * most))
    target = F.when(F.col("_capped"), (F.col(size) * most).cast("double")).otherwise(level_up.cast("double") / (free * 100).cast("double"))
    return ranked.withColumn("target", target).drop("rank", "_before", "_rest", "_total", "_capped")


def _scored(docs: DataFrame, key: str, source: str, text: str, seed: str, *more: Column) -> DataFrame:
    """``key, source, size, sort_key, bucket`` and ``more`` of each row."""
    size = size_of(F.col("text"))
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), *more)
    own = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    u = (F.conv(F.substring(F.md5(own), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    rows = rows.select(*(c for c in rows.columns if c != "text"), size.alias("size"), u.alias("u"), quality_weight(F.col("text"), size).alias("quality"))
    # of keys with rate w, x .. x (1 + d) holds w x exp(-w x) d at most, which is d / e for every w: so for every mixture of weights
    rows = rows.withColumn("sort_key", -F.log("u") / F.col("quality")).withColumn("bucket", F.floor(F.log2("sort_key") * BUCKETS).cast("int"))
    return rows.drop("u", "quality")


def _plan(ws: Workspace, buckets: DataFrame, weights: tuple[int, ...], share_percent: int, most: int) -> DataFrame:
    """Of ``(source, bucket, in_bucket)``: ``before_bucket, source_size, target, epochs, rest``."""
    buckets = ws.save(buckets, "buckets")
    sources = targets(buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), "source", "source_size", weights, share_percent, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = buckets.withColumn("before_bucket", F.coalesce(F.sum("in_bucket").over(up_to), F.lit(0)))
    plan = plan.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    return ws.save(plan.select("b.*", "source_size", "target", "epochs", "rest"), "plan")


def mix(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (3, 1, 2),
    share_percent: int = 150, most: int = 2, seed: str = "mix",
) -> DataFrame:
    """``key, source, size, source_size, target, epochs, selected, taken`` of each row.

    ``taken / size`` is how often a document enters the mix: complete epochs, and
    once more if the fractional sample selects it.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rows = _scored(docs, key, source, text, seed).groupBy("source", "bucket", "sort_key", "key", "size").agg(F.count("*").alias("copies"))
    rows = ws.save(rows, "rows")
    plan = _plan(ws, rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("in_bucket")), weights, share_percent, most)
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    joined = joined.select("r.*", "in_bucket", "before_bucket", "source_size", "target", "epochs", "rest")
    # buckets wholly before or after the budget need no order
    sure = F.when(F.col("before_bucket") + F.col("in_bucket") <= F.col("rest"), True).when(F.col("before_bucket") > F.col("rest"), False)
    joined = joined.withColumn("sure", sure)
    in_order = Window.partitionBy("source", "bucket").orderBy("sort_key", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_bucket") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(in_order), F.lit(0))
    crossing = joined.where("sure IS NULL").withColumn("before", before)
    out = _each_copy(joined.where("sure IS NOT NULL")).withColumn("selected", F.col("sure")).unionByName(
        _each_copy(crossing).withColumn("selected", F.col("before") + F.col("size") * F.col("copy") + F.col("size") / 2 <= F.col("rest")).drop("before")
    ).withColumn("selected", F.col("selected") & (F.col("rest") > 0))
    taken = F.col("size") * (F.col("epochs") + F.col("selected").cast("long"))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "epochs", "selected", taken.alias("taken"))


def mixed(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (3, 1, 2),
    share_percent: int = 150, most: int = 2, seed: str = "mix",
) -> DataFrame:
    """``docs`` as the mix has them: each row once for each epoch, and once more if it is selected.

    Texts are scored twice rather than shuffled: a source's budget ends within one
    bucket, so all other rows are decided by their bucket, and only that bucket's
    rows meet their decisions by row id.  Repeated rows go in order of their ids.
    """
    ws = Workspace(docs.sparkSession, "mixed")
    scan = scanned(docs, ws)
    scored = _scored(scan, key, source, text, seed, row_id(scan).alias("row"))
    rows = ws.save(scored, "rows")
    plan = _plan(ws, rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")), weights, share_percent, most)
    ends = (F.col("before_bucket") <= F.col("rest")) & (F.col("before_bucket") + F.col("in_bucket") > F.col("rest"))
    cut = F.min(F.when(ends, F.struct("bucket", "before_bucket"))).alias("c")
    cuts = plan.groupBy("source").agg(F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), cut)
    cuts = ws.save(cuts.select("source", "epochs", "rest", F.col("c.bucket").alias("cut"), F.col("c.before_bucket").alias("before_cut")), "cuts")  # a line for each source
    at_cut = rows.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.bucket") == F.col("c.cut")))
    in_order = Window.partitionBy("r.source").orderBy("sort_key", "key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_cut") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    chosen = (before + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    decided = ws.save(at_cut.select("row", chosen.alias("chosen")), "decided")
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = _scored(scan, key, source, text, seed, row_id(scan).alias("row"), *(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    whole = whole.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select("row", "bucket", *names, "epochs", "rest", "cut")
    within = (F.col("rest") > 0) & F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True))
    sure = whole.where("cut IS NULL OR bucket <> cut").withColumn("copies", F.col("epochs") + within.cast("long"))
    edge = whole.where("bucket = cut").join(decided, "row").withColumn("copies", F.col("epochs") + F.col("chosen").cast("long"))
    out = sure.select(*names, "copies").unionByName(edge.select(*names, "copies")).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def _each_copy(rows: DataFrame, at_once: int = 1 << 16) -> DataFrame:
    """A row for each of ``copies``, numbered by ``copy``; many copies are dealt out in blocks."""
    last = F.col("copies") - 1
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(at_once).cast("long"))))
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("_block"), F.least(last, F.col("_block") + at_once - 1)))).drop("_block")
