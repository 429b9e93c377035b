"""The registered queries on very long texts, against brute force."""

from __future__ import annotations

import random

import pytest

from tests.llm import brute
from veldspan.llm import queries as q
from veldspan.llm import secretscan, surrogates

WORDS = 300_000
ITEM = " ".join(f"item{i}" for i in range(20))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(12)
    words = [f"w{rng.randrange(20_000)}" for _ in range(WORDS)]
    words[WORDS - 500 : WORDS - 480] = ITEM.split()
    for i in range(0, WORDS, 40):
        words[i] += "\n"
    text = " ".join(words)
    return [(1, text), (2, text + " token = 'abcdefghijkl0123' more"), (3, "a short text of few words"), (4, "\n" * 200_000), (5, "x" * 1_000_000)]


@pytest.fixture(scope="module")
def at(spark, data, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    rows = [(k, t, "en", "a", len(t)) for k, t in data]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([("i", ITEM)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_quality(spark, at, data):
    got = rows(q.op1_quality_rules(spark, at), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {k: brute.quality_base(t) for k, t in data}


def test_tokens(spark, at, data):
    from tokenizers import Tokenizer

    want = brute.token_rows(data, Tokenizer.from_file(q.vocabulary()))
    assert sorted(map(tuple, q.op2_token_store(spark, at).collect())) == want
    lengths = [n for _, _, n, _ in want]
    assert {r.n_tokens: r.n_docs for r in q.op6_token_counts(spark, at).collect()} == {n: lengths.count(n) for n in lengths}


def test_simhash(spark, at, data):
    fps = [(k, brute.fingerprint(t)) for k, t in data]
    parts = brute.components(fps)
    assert rows(q.op3_simhash_dedup(spark, at), "fingerprint", "component_id") == {k: (f"{fp:016x}", parts[k]) for k, fp in fps}


def test_mix(spark, at, data):
    got = {r.doc_id: r for r in q.op4_source_mix(spark, at).collect()}
    size = {k: len(brute.WORD.findall(t)) for k, t in data}
    assert {k: r["size"] for k, r in got.items()} == size
    assert abs(sum(r.taken for r in got.values()) - 1.5 * sum(size.values())) <= max(size.values()) / 2 + 1


def test_secrets_and_surrogates(spark, at, data):
    got = rows(q.op5_secret_scan(spark, at), "n_assign", "spans")
    assert {k: n for k, (n, _) in got.items()} == {k: int(k == 2) for k, _ in data}
    assert got[2][1] == ",".join(f"{kind}:{a}:{z}" for a, z, kind in secretscan.find(data[1][1]))
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = {r.doc_id: r.text for r in surrogates.pseudonymize(docs, "k").collect()}
    assert out == dict(data)


def test_substrings(spark, at, data):
    got = rows(q.op7_substring_dedup(spark, at), "n_words", "n_removed", "kept_sha256")
    assert got == {k: (n, m, brute.sha(kept)) for k, (n, m, kept) in brute.substring_rows(data).items()}
    assert got[2][1] > WORDS - 20


def test_lines(spark, at, data):
    got = rows(q.op9_line_dedup(spark, at), "n_lines", "n_dropped", "kept_sha256")
    assert got == {k: (n, m, brute.sha(kept)) for k, (n, m, kept) in brute.line_rows(data).items()}


def test_decontaminate(spark, at, data):
    got = rows(q.op10_decontaminate(spark, at), "n_words", "n_hit", "n_items", "contaminated")
    assert got == {k: (a, b, c, bad) for k, (a, b, c, _, bad) in brute.leak_rows(data, [("i", ITEM)]).items()}
