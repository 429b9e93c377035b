"""The window index over several batches: shards that split, and the registered query's history."""

from __future__ import annotations

import pathlib
import random

import numpy as np

from tests.llm import brute
from veldspan.llm import queries as q
from veldspan.llm import substrings


def made(n):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    data = []
    for k in range(n):
        cut = rng.randrange(20)
        data.append((k, " ".join([f"v{rng.randrange(300)}" for _ in range(rng.randrange(60))] + passage[cut : cut + rng.randrange(10, 20)])))
    return data


def test_shards_split_as_the_index_grows(spark):
    data, got = made(80), {}
    index = substrings.SubstringIndex(spark, block_bytes=2000, shard_windows=32)
    for a, z in ((0, 4), (4, 30), (30, 80)):
        batch = spark.createDataFrame(data[a:z], "doc_id long, text string")
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in index.dedup(batch).collect()}
    assert got == brute.substring_rows(data)
    assert index.bits > 3
    held = set()
    for r in index.runs.collect():
        for h, s in substrings.read_run(r.file, *substrings._bounds(r.shard, index.bits)):
            held |= set(zip(h.tolist(), s.tolist(), strict=True))
    words = [t.split() for _, t in data]
    assert len(held) == len({tuple(w[i : i + 13]) for w in words for i in range(len(w) - 12)})


def test_history_decides(spark, monkeypatch):
    """Without what the runs hold, a later batch keeps what an earlier one had."""
    text = " ".join(f"x{i}" for i in range(30))
    first, second = ([(k, text)] for k in (1, 2))

    def removed():
        index = substrings.SubstringIndex(spark)
        return [index.dedup(spark.createDataFrame(rows, "doc_id long, text string")).first().n_removed for rows in (first, second)]

    assert removed() == [0, 30]
    index = substrings.SubstringIndex(spark)
    for rows in (first, second):
        out = index.dedup(spark.createDataFrame(rows, "doc_id long, text string"), add=False)
    assert out.first().n_removed == 0


def test_run_files(tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 64)
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 2**64, 1000, np.uint64))
    h[100:140] = h[100]  # equal hashes, over chunks, of different fingerprints
    s = np.arange(1000, dtype=np.uint16)
    uri = f"file://{tmp_path}/a.run"
    substrings.write_run(uri, h, s)
    everything = np.uint64(0), np.uint64(2**64 - 1)
    back = list(substrings.read_run(uri, *everything))
    assert len(back) > 10 and (np.concatenate([x for x, _ in back]) == h).all() and (np.concatenate([x for _, x in back]) == s).all()
    for low, high in ((h[100], h[100]), (h[10], h[700]), (h[999] + 1, everything[1]), (everything[0], h[0])):
        got = [x for part, _ in substrings.read_run(uri, low, high) for x in part.tolist()]
        assert got == h[(h >= low) & (h <= high)].tolist()
    wrong = s.copy()
    wrong[::3] += 2000
    assert (substrings.held(h, wrong, substrings.read_run(uri, *everything)) == (wrong == s)).all()


def test_rolling_hash_depends_on_all_words():
    words = np.random.default_rng(5).integers(0, 2**64, 40, np.uint64)
    for width in (1, 2, 5, 13):
        whole = substrings._rolling(words, width, 1)
        assert len(whole) == 41 - width
        for i in range(len(whole)):
            assert (substrings._rolling(words[i : i + width], width, 1) == whole[i]).all()
        for k in range(40):
            other = words.copy()
            other[k] += np.uint64(1)
            changed = np.flatnonzero(substrings._rolling(other, width, 1) != whole)
            assert changed.tolist() == [i for i in range(len(whole)) if i <= k < i + width]


def test_registered_query_builds_and_uses_history(spark, monkeypatch, tmp_path):
    indexes = []

    class Kept(substrings.SubstringIndex):
        def __init__(self, *args, **kw):
            super().__init__(*args, **kw)
            indexes.append(self)

    monkeypatch.setattr(substrings, "SubstringIndex", Kept)
    data = made(40)
    spark.createDataFrame(data + [(None, data[0][1])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in q.op7_substring_dedup(spark, str(tmp_path)).collect()}
    n, removed, _ = got.pop(None)
    assert n and removed == 0
    assert got == {k: (n, m, brute.sha(kept)) for k, (n, m, kept) in brute.substring_rows(data).items()}
    (index,) = indexes
    assert index._batch == substrings.FANOUT and not index.runs.isEmpty()
    runs = {r.shard: r["count"] for r in index.runs.groupBy("shard").count().collect()}
    assert max(runs.values()) <= substrings.FANOUT and min(runs.values()) < max(runs.values())  # some have been compacted
    left = {p.name for p in pathlib.Path(index.folder.removeprefix("file://")).glob("*.run")}
    assert left == {r.file.rsplit("/", 1)[1] for r in index.runs.collect()}  # and what was compacted has gone
