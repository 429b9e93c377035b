"""The filters of line dedup: they decide, they are confirmed, and they grow."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from tests.llm import brute
from veldspan.llm import lines


def made(first, n, common):
    """Documents whose lines ``common`` are in all of them."""
    return [(first + i, "\n".join([*common, f"own {first + i}", f"Half {i % 2}"])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def result(index, docs, **how):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in index.dedup(docs, **how).collect()}


def test_filters_decide_and_are_confirmed(spark, monkeypatch):
    rows = made(0, 12, ["a", "b"])
    docs = frame(spark, rows)
    index = lines.LineIndex(spark, threshold=5).insert(docs)
    want = brute.line_rows(rows, 5)
    assert result(index, docs) == want and any(n for _, n, _ in want.values())
    for answer in (False, True):
        # workers unpickle the patched method along with its class by name, so patch what they run
        monkeypatch.setattr(lines.LineIndex, "_passing", patched_passing(answer))
        monkeypatch.setattr(lines.LineIndex, "_dedup_mapped", patched_mapped(answer, lines.LineIndex._dedup_mapped))
        got = result(index, docs)
        monkeypatch.undo()
        if answer:  # a filter that holds everything: the join with the exact counts refutes the rest
            assert got == want
        else:
            assert all(n == 0 for _, n, _ in got.values())


def patched_passing(answer):
    def passing(self, filters):
        min_chars = self.min_chars

        def each(b):
            _, keys, some = lines._line_keys(lines.raw(b.column(0)), min_chars)
            found = {k.tobytes() for k in keys[some]} if answer else set()
            return lines.batch(key=lines.pa.array(list(found), lines.pa.binary()))

        return each

    return passing


def patched_mapped(answer, real):
    def mapped(self, docs, text, filters, exceptions):
        keys = {lines.line_key(x) for r in docs.collect() for x in r[text].encode().split(b"\n")}
        dumps = {}
        for shard in range(self.shards):
            f = lines.CuckooFilter(1000)
            for k in keys:
                if answer:
                    f.insert(k)
            dumps[shard] = f.dump()
        return real(self, docs, text, self.spark.sparkContext.broadcast(dumps), exceptions)

    return mapped


def test_many_keys_at_once_as_one_by_one():
    keys = [xxhash.xxh3_128_digest(str(i).encode()) for i in range(4000)]
    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    for shards, capacity in ((1, 3000), (4, 700), (4, 20)):  # the last has to use its stash
        filters = {k: lines.CuckooFilter(capacity) for k in range(shards)}
        shard = lines.shard_of(rows, shards)
        for k, s in zip(keys[:2000], shard, strict=False):
            filters[int(s)].insert(k)
        got = lines.Filters({k: f.dump() for k, f in filters.items()}, shards).hold(rows)
        assert got.tolist() == [k in filters[int(s)] for k, s in zip(keys, shard, strict=True)]
        assert got[:2000].all() and got[2000:].mean() < 0.01
    assert not lines.Filters({}, 8).hold(rows).any()


@pytest.mark.parametrize("shard_keys", [1 << 17, 16])
def test_filters_grow_with_their_keys(spark, shard_keys):
    first, second = made(0, 6, [f"few {i}" for i in range(12)]), made(100, 6, [f"many {i}" for i in range(900)])
    a, b = frame(spark, first), frame(spark, second)
    one = lines.LineIndex(spark, threshold=5, shard_keys=shard_keys).insert(a)
    both = one.insert(b)
    assert both.shards == (8 if shard_keys > 16 else 64) and one.shards == 8
    for index in (one, both, both.delete(b)):
        shards = index.filters.collect()
        assert len(shards) == len({r.shard for r in shards}) <= index.shards
        for r in shards:
            assert r.n <= lines.LOAD * r.slots and not lines.CuckooFilter.load(bytes(r["filter"])).stash
    every = a.unionByName(b)
    for size in (1 << 30, 3000, 0):
        assert result(both, every, broadcast_bytes=size) == brute.line_rows(first + second, 5)
    assert result(both.delete(b), every) == {k: v if k < 100 else (len(t.split("\n")), 0, t) for k, v, t in ((k, brute.line_rows(first, 5).get(k), t) for k, t in first + second)}
