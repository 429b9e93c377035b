"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item is the set of its windows of ``width`` consecutive words (one shorter
window if it has fewer words).  Words are ordered by rarity over all documents;
a window can occur only where its rarest word does, so that word is the prefix
that must be joined.  Each occurrence of such a word in a document is joined with
the windows it stands for; bounds on position (the window's start may not lie
before the text) and length (nor its end behind it) drop most pairs, and the
rest are verified by comparing all words.

The benchmark's words are matched by literal sets while there are few of them
(``max_literals``, a bound on driver and task memory); beyond that the same join
runs by shuffling words.  Both ways give the same rows.

Defined results: a null text has no words; rows are judged each by itself, so
repeated rows and null keys are kept apart; items without words are never hit;
items of equal key count once; of words equally rare the least is the prefix, which
changes no result; a very long text is searched whole; extra columns, of whatever
name, are not read or, in ``clean``, pass by untouched; empty tables give no hits or
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspan.llm.common import numbered
from veldspan.workspace import Workspace

#: What stands between words: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_LITERALS = 50_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows_of(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``(item, window, words)``: each distinct window of each item."""
    w = items.select(F.col(key).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words"))
    return each.select("item", F.array_join("words", " ").alias("window"), "words").distinct()


def _few(df: DataFrame, column: str, most: int) -> list[str] | None:
    """The column's values if there are at most ``most``."""
    values = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    return values if len(values) <= most else None


def count_words(docs: DataFrame, text: str, vocabulary: DataFrame, max_literals: int) -> DataFrame:
    """``(word, n)``: occurrences of the vocabulary's words in all documents; to be broadcast if they are at most ``max_literals``."""
    words = words_of(F.col(text))
    if (known := _few(vocabulary, "word", max_literals)) is not None:
        own = docs.select(F.explode(words).alias("word")).where(F.col("word").isin(known) if known else F.lit(False))
        return F.broadcast(own.groupBy("word").agg(F.count("*").alias("n")))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(window, words, word, offset)``: each window's rarest word and where it stands."""
    each = windows.select("window", "words").distinct().select("window", "words", F.posexplode("words").alias("offset", "word"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("offset"))
    best = each.join(counts, "word", "left").groupBy("window").agg(F.min(rarity).alias("b"), F.first("words").alias("words"))
    return best.select("window", "words", F.col("b.word").alias("word"), F.col("b.offset").alias("offset"))


def decontaminate(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    width: int = 13, percent: int = 5, max_literals: int = MAX_LITERALS,
) -> DataFrame:
    """Each row's ``n_words, n_hit, longest`` (words of its longest hit), ``n_items, items`` (sorted as strings) and ``contaminated``."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    windows = ws.save(windows_of(items, item_key, item_text, width), "windows")
    counts = count_words(own, "text", windows.select(F.explode("words").alias("word")).distinct(), max_literals)
    prefixes = ws.save(_prefixes(windows, counts), "prefixes")
    rows = own.withColumn("row", F.monotonically_increasing_id()).withColumn("w", words_of(F.col("text")))
    rare = _few(prefixes, "word", max_literals)
    hits = None
    if rare is not None:
        base, hits = _hits_in_context(ws, rows, prefixes, rare, width)
    else:
        base, hits = _hits_by_join(ws, rows, prefixes)
    hits = ws.save(hits, "hits")
    spans = F.collect_set(F.struct("start", "length"))  # within one document
    marked = hits.groupBy("row").agg(spans.alias("spans"), F.max("length").cast("long").alias("longest"))
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    marked = marked.select("row", F.size(F.array_distinct(inside)).cast("long").alias("n_hit"), "longest")
    found = hits.select("row", "window").distinct().join(windows.select("window", "item"), "window").select("row", "item").distinct()
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = base.join(marked, "row", "left").join(found, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest"), F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, width: int = 13, **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, as they are.

    A row goes if one whole window of ``width`` words occurs in it, however long
    its text is, or if it is ``contaminated``.  Items shorter than a window are a
    few words that may stand anywhere; a row goes for them only if it is contaminated.
    """
    ws = Workspace(docs.sparkSession, "decontaminated")
    rows = numbered(docs, ws)
    found = decontaminate(rows, items, **how | {"key": "__row", "width": width})
    bad = ws.save(found.where(F.col("contaminated") | (F.col("longest") >= width)).select("__row"), "bad")
    return rows.join(bad, "__row", "left_anti").select(*docs.columns)


def _hits_in_context(ws: Workspace, rows: DataFrame, prefixes: DataFrame, rare: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts keeps, of each document, the words around each prefix word."""
    at = F.array_compact(F.transform("w", lambda w, i: F.when(w.isin(rare), i))) if rare else F.array().cast("array<int>")
    rows = rows.withColumn("at", at)

    def around(i: Column) -> Column:
        first = F.greatest(i - (width - 1), F.lit(0))
        return F.struct(i.alias("pos"), first.alias("first"), F.slice("w", first + 1, 2 * width - 1).alias("near"))

    table = ws.save(rows.select("row", "key", F.size("w").cast("long").alias("n_words"), F.transform("at", around).alias("around")), "around")
    near = table.select("row", F.explode("around").alias("c")).select("row", "c.*")
    near = near.withColumn("word", F.element_at("near", F.col("pos") - F.col("first") + 1))
    pairs = near.join(prefixes, "word")
    begin = F.col("pos") - F.col("first") - F.col("offset")
    length = F.size("words")
    pairs = pairs.where((begin >= 0) & (begin + length <= F.size("near")))
    verified = pairs.where(F.slice("near", begin + 1, length) == F.col("words"))
    hits = verified.select("row", (F.col("pos") - F.col("offset")).alias("start"), length.alias("length"), "window")
    return table.select("row", "key", "n_words"), hits.distinct()


def _hits_by_join(ws: Workspace, rows: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every word of every document meets the prefixes in a shuffle; candidates meet their text again."""
    table = ws.save(rows.select("row", "key", F.size("w").cast("long").alias("n_words"), "w"), "words")
    words = table.select("row", "n_words", F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("offset")
    pairs = words.join(prefixes, "word").where((start >= 0) & (start + F.size("words") <= F.col("n_words")))
    pairs = pairs.groupBy("row").agg(F.collect_set(F.struct(start.alias("start"), "window", "words")).alias("c"))  # within one document
    good = F.filter("c", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["words"])) == c["words"])
    hits = table.join(pairs, "row").select("row", F.explode(good).alias("c"))
    return table.select("row", "key", "n_words"), hits.select("row", "c.start", F.size("c.words").alias("length"), "c.window")
