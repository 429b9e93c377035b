"""Components of named and numbered nodes against union-find."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veldspan import components as c


def union(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["long", "string", "string without hashes"])
def test_against_union_find(spark, monkeypatch, kind):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (2000, 2000)]
    if kind == "long":
        df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    else:
        edges = [(f"n{a}", f"n{b}") for a, b in edges]
        df = spark.createDataFrame([*edges, (None, "n1")], "a string, b string")
    if kind == "string without hashes":
        monkeypatch.setattr(c.F, "xxhash64", lambda *cols, real=F.xxhash64: real(*cols) if len(cols) > 1 else real(*cols) % 5)
    got = {r.node: r.component for r in c.connected_components(df, "a", "b").collect()}
    assert got == union(edges)


def test_no_edges(spark):
    for kind in ("long", "string"):
        assert c.connected_components(spark.createDataFrame([], f"a {kind}, b {kind}"), "a", "b").isEmpty()


def test_numbers_tell_the_same_components_apart(spark, tmp_path):
    """without names; a scan of files is read again, not stored."""
    edges = [(f"n{a}", f"n{b}") for a, b in [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200)]]
    spark.createDataFrame(edges, "a string, b string").write.parquet(f"{tmp_path}/edges")
    df = spark.read.parquet(f"{tmp_path}/edges").where("a <> ''")
    assert c.is_plain(df) and not c.is_plain(df.distinct())
    got = {r.node: r.component for r in c.component_numbers(df, "a", "b").collect()}
    want = union(edges)
    assert got.keys() == want.keys() and len({(got[x], want[x]) for x in got}) == len(set(want.values())) == len(set(got.values()))
