"""The registered neighbourhood query against breadth-first search from every concept."""

from __future__ import annotations

from collections import defaultdict

from veldspan.queries import QUERIES


def test_every_concept_has_its_neighbourhood(spark, tmp_path):
    columns = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double, l_tax double, l_discount double"
    lines = [(o, n, o + n, 3 * o + n * n, "ARN"[n % 3] if o % 5 else "A", "F" if (o + n) % 4 else "O", 1.0, 0.1, 0.05) for o in range(1, 60) for n in range(1, 6)]
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    near = defaultdict(set)
    for o, n, s, p, flag, status, *_ in lines:
        if flag + status in ("AF", "RF"):
            a = f"{('doid', 'mesh', 'umls', 'efo')[n % 4]}:{o // 4}-{s % 2}"
            b = f"{('doid', 'mesh', 'umls', 'efo', 'ncit')[p % 5]}:{o // 4}-{p % 2}"
            near[a].add(b)
            near[b].add(a)
    want = set()
    for source in near:
        seen, front = {source}, {source}
        for d in range(1, 4):
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            want |= {(source, y, d) for y in front}
    got = [tuple(r) for r in QUERIES["khop_exact"](spark, str(tmp_path)).select("source", "curie", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {s.split(":")[1].split("-")[0] for s, _, _ in got} > {"0"}  # not only every hundredth cluster
