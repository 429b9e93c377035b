"""Quality rules with thresholds that adapt to language and source.

Fixed cutoffs misjudge a language or source whose ordinary texts look unusual.
Here each (language, source) has its own fences, read off mergeable quantile
sketches: log-linear histograms of integers with 7 significant bits (relative
error under 1 %), whose merge is the sum of counts.  They are exact under any
order of merging, so reruns and recomputed tasks agree.  Sketches of groups
under ``min_group`` documents are replaced by that of their language, and that
by that of the corpus: coarser sketches are merges of the finer ones.

A fence lies beyond a learnt tail quantile by ``reach`` times that tail's width,
its distance from the median: ``Q(tail) + reach * (Q(tail) - Q(1/2))``, and the
same downwards.  A rule's ``tail`` leaves out what may be junk: 1/10 where junk
shows in many documents, 1/100 where it hardly does.  Only a tail narrower than
``floor`` counts as that wide; ``decided_by_floor`` in ``thresholds`` tells where.

Defined results: a null text has no words and fails the base rules; null
language or source is a group of its own; repeated rows and ties are judged alike,
each by itself; a value on a fence is kept; a very long text is measured whole; an
empty table gives no rows; extra columns, of whatever name, are not read or, in
``keep``, pass by untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspan.llm.common import arrow_map, batch, raw
from veldspan.workspace import Workspace

_SPACE_AND_TAILS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
_SYMBOLS = b"#*$%&|<>"
#: Significant bits of a sketch's buckets.
BITS = 7


@dataclass(frozen=True)
class Rule:
    """A measured integer and how far beyond its tail it may lie.

    ``tail`` is the share of a group, in percent, beyond the quantile that fences
    start from.  ``floor`` is the least width of a tail that counts, so a group
    whose documents are nearly all alike doesn't reject those that differ a little.
    """

    metric: str
    value: str  # SQL over the statistics' columns
    floor: int
    tail: int = 10
    reach: int = 3
    low: bool = False
    high: bool = True


RULES = (
    Rule("word_length", "100 * word_chars DIV greatest(n_words, 1)", 10, low=True),
    Rule("symbols", "1000 * n_symbols DIV greatest(n_words, 1)", 20),
    Rule("dup_lines", "1000 * n_dup_lines DIV greatest(n_lines, 1)", 40, tail=1, reach=1),
    Rule("repeats", "1000 * n_repeat_words DIV greatest(n_words, 1)", 40, tail=1, reach=1),
)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """Of each text, the words in 3-word windows that occur twice or more in it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(sizes.sum())
    out = np.zeros(len(texts), np.int64)
    if n < 3:
        return out
    number = dict.fromkeys(w for ws in texts for w in ws)
    for i, w in enumerate(number):
        number[w] = i
    ids = np.fromiter((number[w] for ws in texts for w in ws), np.int64, n)
    doc = np.repeat(np.arange(len(texts)), sizes)
    same = doc[2:] == doc[:-2]
    at = np.flatnonzero(same)
    if not len(at):
        return out
    v = len(number)
    _, pair = np.unique(ids[at] * v + ids[at + 1], return_inverse=True)
    _, triple = np.unique(pair * v + ids[at + 2], return_inverse=True)
    _, key, count = np.unique(doc[at] * (int(triple.max()) + 1) + triple, return_inverse=True, return_counts=True)
    hit = at[count[key] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(doc[covered], minlength=len(texts))


def _measure(texts: list[bytes]) -> dict[str, pa.Array]:
    words = [t.split() for t in texts]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    columns = {
        "n_words": map(len, words),
        "word_chars": (len(t.translate(None, _SPACE_AND_TAILS)) for t in texts),
        "n_symbols": (len(t) - len(t.translate(None, _SYMBOLS)) for t in texts),
        "n_dup_lines": (len(x) - len(set(x)) for x in lines),
        "n_repeat_words": repeated_words(words),
        "n_lines": map(len, lines),
    }
    return {k: pa.array([int(x) for x in v], pa.int64()) for k, v in columns.items()}


def measure(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` columns and the statistics of each whole text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    at = keep.index(text) if text in keep else len(keep)  # a text that is kept isn't sent twice

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(**{c: b.column(c) for c in keep}, **_measure(raw(b.column(at))))

    own = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("__text"))
    return arrow_map(own, each, f"{fields}, {STATS}")


def bucket(value: F.Column) -> F.Column:
    """The sketch's bucket of an integer >= 0."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - F.lit(BITS)).cast("int")
    return shift.cast("long") * F.lit(1 << BITS) + F.call_function("shiftright", value, shift)


def lowest(b: F.Column) -> F.Column:
    """The least value of a bucket."""
    shift = F.call_function("shiftright", b, F.lit(BITS)).cast("int")
    return F.call_function("shiftleft", b - shift.cast("long") * F.lit(1 << BITS), shift)


def highest(b: F.Column) -> F.Column:
    """The greatest value of a bucket."""
    shift = F.call_function("shiftright", b, F.lit(BITS)).cast("int")
    return F.call_function("shiftleft", b - shift.cast("long") * F.lit(1 << BITS) + 1, shift) - 1


def sketch(rows: DataFrame, groups: list[str], metrics: dict[str, F.Column]) -> DataFrame:
    """``(groups, metric, bucket, n)``: one log-linear histogram for each group and metric."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in metrics.items())))
    rows = rows.select(*groups, each.alias("x")).select(*groups, "x.*")
    return rows.groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """``(groups, metric, size, low, mid, high)``: the median and both tails' quantiles from each group's cumulated buckets."""
    w = Window.partitionBy(*groups, "metric")
    total = F.sum("n").over(w)
    before = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ranked = sketches.select("*", total.alias("size"), F.coalesce(before, F.lit(0)).alias("before"))
    tail = F.lit(None).cast("int")
    for r in rules:
        tail = F.when(F.col("metric") == r.metric, r.tail).otherwise(tail)

    def at(percent: F.Column) -> F.Column:
        rank = F.greatest(F.floor((F.col("size") * percent + 99) / 100), F.lit(1))
        return (F.col("before") < rank) & (F.col("before") + F.col("n") >= rank)

    b = F.col("bucket")
    return ranked.groupBy(*groups, "metric").agg(
        F.max("size").alias("size"), F.max(F.when(at(tail), lowest(b))).alias("low"),
        F.max(F.when(at(F.lit(50)), lowest(b))).alias("mid"), F.max(F.when(at(100 - tail), highest(b))).alias("high"),
    )


def thresholds(sketches: DataFrame, groups: list[str], rules: tuple[Rule, ...], min_group: int) -> DataFrame:
    """``(groups, low_<metric>, high_<metric>, decided_by_floor)``; small groups fall back to coarser merges."""
    levels, read = [groups[:k] for k in range(len(groups), -1, -1)], ("size", "low", "mid", "high")
    fences = None
    for k, level in enumerate(levels):
        q = quantiles(sketches if k == 0 else merge(sketches, level), level, rules)
        q = q.select(*level, "metric", *(F.col(c).alias(f"{c}_{k}") for c in read))
        if fences is None:
            fences = q
            continue
        on = F.col("a.metric") == F.col("b.metric")
        for g in level:
            on &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
        fences = fences.alias("a").join(q.alias("b"), on).select("a.*", *(f"b.{c}_{k}" for c in read))
    last = len(levels) - 1
    chosen = {}
    for c in read[1:]:
        e = F.col(f"{c}_{last}")
        for k in range(last - 1, -1, -1):
            e = F.when(F.col(f"size_{k}") >= min_group, F.col(f"{c}_{k}")).otherwise(e)
        chosen[c] = e
    out, floored = [], []
    for r in rules:
        this, up, down = F.col("metric") == r.metric, chosen["high"] - chosen["mid"], chosen["mid"] - chosen["low"]
        out.append(F.max(F.when(this, chosen["low"] - F.greatest(F.lit(r.floor), down) * r.reach)).alias(f"low_{r.metric}"))
        out.append(F.max(F.when(this, chosen["high"] + F.greatest(F.lit(r.floor), up) * r.reach)).alias(f"high_{r.metric}"))
        narrow = (F.lit(r.low) & (down < r.floor)) | (F.lit(r.high) & (up < r.floor))
        floored.append(F.when(F.max(F.when(this, narrow)), F.lit(r.metric)))
    return fences.groupBy(*groups).agg(*out, F.concat_ws(",", *floored).alias("decided_by_floor"))


def _fences(ws: Workspace, stats: DataFrame, groups: list[str], rules: tuple[Rule, ...], min_group: int) -> DataFrame:
    """Each group's thresholds, learnt from the documents that pass the base rules."""
    metrics = {r.metric: F.expr(r.value) for r in rules}
    return ws.save(thresholds(sketch(stats.where("NOT base_failed"), groups, metrics), groups, rules, min_group), "fences")


def _with_base(measured: DataFrame, min_words: int, max_repeat_percent: int) -> DataFrame:
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def _judged(stats: DataFrame, fences: DataFrame, groups: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """``stats`` with ``failed_rules`` and ``kept``.  ``fences`` has a line for each group and is broadcast if it is small."""
    on = F.lit(True)
    for g in groups:
        on &= F.col(f"s.{g}").eqNullSafe(F.col(f"f.{g}"))
    bounds = [c for c in fences.columns if c.startswith(("low_", "high_"))]
    rows = stats.alias("s").join(fences.alias("f"), on, "left").select("s.*", *bounds)
    broken = []
    for r in rules:
        value, beyond = F.expr(r.value), F.lit(False)
        if r.low:
            beyond |= value < F.col(f"low_{r.metric}")
        if r.high:
            beyond |= value > F.col(f"high_{r.metric}")
        broken.append(F.when(~F.col("base_failed") & beyond, F.lit(r.metric)))
    rows = rows.withColumn("failed_rules", F.concat_ws(",", *broken)).drop(*bounds)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def quality(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source"), rules: tuple[Rule, ...] = RULES,
    min_group: int = 100, min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """Each row's ``key``, groups, statistics, ``base_failed``, ``failed_rules`` and ``kept``.

    Thresholds are learnt from the documents that pass the base rules.
    """
    ws, names = Workspace(docs.sparkSession, "quality"), [f"g{i}" for i in range(len(groups))]
    own = docs.select(F.col(key).alias("key"), *(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), F.col(text).alias("text"))
    stats = _with_base(ws.save(measure(own, "text", "key", *names), "stats"), min_words, max_repeat_percent)
    rows = _judged(stats, _fences(ws, stats, names, rules, min_group), names, rules)
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "failed_rules", "kept")
    return rows.select(F.col("key").alias(key), *(F.col(n).alias(g) for n, g in zip(names, groups, strict=True)), *out)


def keep(
    docs: DataFrame, *, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), rules: tuple[Rule, ...] = RULES,
    min_group: int = 100, min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """The rows of ``docs`` that pass all rules, as they are.

    Texts are measured twice, for the thresholds and for the verdict; so they are
    neither copied nor shuffled.
    """
    ws, names = Workspace(docs.sparkSession, "quality"), [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    own, by = docs.toDF(*names), [of[g] for g in groups]
    stats = _with_base(ws.save(measure(own, of[text], *by), "stats"), min_words, max_repeat_percent)
    fences = _fences(ws, stats, by, rules, min_group)
    rows = _judged(_with_base(measure(own, of[text], *names), min_words, max_repeat_percent), fences, by, rules)
    return rows.where("kept").select(*(F.col(n).alias(c) for c, n in of.items()))
