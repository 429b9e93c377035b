"""The registered queries: digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan.llm import decontaminate, lengths, lines, mixing, quality, secretscan, simhash, substrings, surrogates, tokenstore
from veldspan.llm.common import documents
from veldspan.workspace import Workspace


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path
    tokenstore.write(documents(spark, sf_dir), path, vocabulary())
    return tokenstore.read_back(spark, path)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.secrets(documents(spark, sf_dir))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secretscan.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, secretscan.BASE)
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(documents(spark, sf_dir), vocabulary())


def _key_ranges(docs: DataFrame, key: str, n: int) -> list[DataFrame]:
    """``docs`` in up to ``n`` parts of ascending keys; null keys are in the first, equal keys in one part."""
    cuts = sorted({int(x) for x in docs.approxQuantile(key, [i / n for i in range(1, n)], 0.01)})
    at = F.lit(0)
    for cut in cuts:
        at = at + F.coalesce(F.col(key) > cut, F.lit(False)).cast("int")
    return [docs.where(at == i) for i in range(len(cuts) + 1)]


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes to the index in batches of ascending keys, each judged against those before."""
    index, out = substrings.SubstringIndex(spark), None
    for batch in _key_ranges(documents(spark, sf_dir), "doc_id", substrings.FANOUT):
        own = index.dedup(batch)
        out = own if out is None else out.unionByName(own)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(documents(spark, sf_dir), "production key")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = lines.LineIndex(spark, threshold=10).insert(docs).dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_store, op3_simhash_dedup, op4_source_mix, op5_secret_scan,
        op6_token_counts, op7_substring_dedup, op8_pii_surrogates, op9_line_dedup, op10_decontaminate,
    )
}
