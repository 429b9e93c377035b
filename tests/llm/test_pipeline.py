"""Each stage against brute force, on its own input."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
import pytest

from tests.llm import brute
from tests.llm.test_resemblance import expected
from veldspan.llm import decontaminate, mixing
from veldspan.llm import queries as q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append([tuple(r) for r in docs.collect()])
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / "out")
        df = stage(spark, docs, SF)
        if k < 4:
            assert df.columns == columns
        df.write.parquet(at)
        docs = spark.read.parquet(at)
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_quality_keeps_what_the_operator_keeps(spark, stages):
    kept = {r["doc_id"] for r in q.op1_quality_rules(spark, SF).collect() if r["kept"]}
    assert sorted(stages[1]) == sorted(r for r in stages[0] if r[0] in kept)
    assert kept and not any(brute.quality_base(r[1])[5] for r in stages[1])


def test_one_of_each_group_stays(stages):
    want = set(expected([r[:2] for r in stages[1]]))
    assert sorted(stages[2]) == sorted(r for r in stages[1] if r[0] in want)


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {k for k, r in brute.leak_rows([r[:2] for r in stages[2]], items).items() if r[1]}  # items have a window of 13 words or more
    assert bad and sorted(stages[3]) == sorted(r for r in stages[2] if r[0] not in bad)
    left = brute.leak_rows([r[:2] for r in stages[3]], items)
    assert not any(r[1] for r in left.values())  # no window of the benchmark outlives the stage


def test_one_window_in_a_long_text_is_enough(spark):
    item = " ".join(f"q{i}" for i in range(20))
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, f"{long} {' '.join(item.split()[3:16])} {long}"), (2, f"{long} {' '.join(item.split()[3:15])} {long}"), (3, "q1 q2 " + long), (4, "short item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("a", item), ("b", "short item"), ("c", "q1 q2")], "item_id string, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 3]


def test_mix_repeats_whole_documents(stages):
    before, after = Counter(stages[3]), Counter(stages[4])
    assert set(after) <= set(before) and max(after.values()) <= 2
    size = {r: len(brute.WORD.findall(r[1])) for r in before}
    total = sum(size.values())
    longest = max(size.values())
    assert abs(sum(size[r] * n for r, n in after.items()) - 1.5 * total) <= longest * len({r[3] for r in before})


def test_mixed_rows_follow_the_mix(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").schema
    before = spark.createDataFrame(stages[3], columns)
    want = {r["doc_id"]: r["epochs"] + r["selected"] for r in mixing.mix(before).collect()}
    got = Counter(r[0] for r in stages[4])
    assert {k: got[k] for k in want} == want


def test_tokens(stages):
    from tokenizers import Tokenizer

    assert sorted(stages[5]) == brute.token_rows([r[:2] for r in stages[4]], Tokenizer.from_file(q.vocabulary()))


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(stages[5])


def test_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (None, words, None, None, None), (2, None, "en", "a", 1), (3, "", None, "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"n_chars": "size"})
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == before
        if name.startswith("quality"):
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "None"]
        if name.startswith("SimHash"):
            assert [r["doc_id"] for r in docs.collect()] == [1]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_token_shards_on_odd_rows(spark):
    from tokenizers import Tokenizer

    rows = [(1, "One two", 5, "x"), (1, "One two", 5, "x"), (None, "three", None, None), (2, None, 1, "y"), (3, "", 1, "y"), (None, None, 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, key string")  # names of the result and of the operator's own
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect())
    want = brute.token_rows([(-1 if k is None else k, t or "") for k, t, *_ in rows], Tokenizer.from_file(q.vocabulary()))
    assert got == sorted((str(None if k == -1 else k), n, crc) for k, _, n, crc in want)
