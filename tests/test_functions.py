from __future__ import annotations

from pyspark.sql import functions as F

from tests.data import row, rows
from veldspan.functions import confidence, formats, refs
from veldspan.registry import REGISTRY
from veldspan.schema import EXACT, MANUAL


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_triple_ids_are_hashes_of_uris(spark):
    df = rows(spark, row("mesh:C406527", EXACT, "chebi:101854"), row("chebi:101854", EXACT, "chembl.compound:CHEMBL459505"), row("mesh:C406527", EXACT, "chembl.compound:CHEMBL459505"))
    # SHA-256 of the expanded triples.
    want = {
        "mapping:eacc57c4a2bbfb9e5f00c8fc1fa6df4c4968f5b417c508628066be9856054f23",
        "mapping:0a3a5f5e9055f1bb4d58268ad9a0736a16ff68bacc026df0c51425036248c881",
        "mapping:637fee94e47a222e670bd80d31416519a45b7984b7a53729132176d2a63007bf",
    }
    assert {r.x for r in df.select(refs.triple_id().alias("x")).collect()} == want


def test_evidence_ids_ignore_the_set(spark):
    a, b, c = (row("doid:1", EXACT, "mesh:D1", 0.9, justification=MANUAL, author=x, ms_id=y) for x, y in (("p", "s"), ("p", "t"), ("q", "s")))
    ids = [r.x for r in rows(spark, a, b, c).select("author", refs.evidence_id().alias("x")).orderBy("author").collect()]
    assert ids[0] == ids[1] != ids[2]


def test_references(spark):
    assert value(spark, refs.curie(F.lit("a"), F.lit("b:c"))) == "a:b:c"
    assert value(spark, refs.identifier_of(F.lit("a:b:c"))) == "b:c" and value(spark, refs.prefix_of(F.lit("none"))) is None
    assert value(spark, refs.normalized_curie(F.lit("DO:5"))) == "doid:5"
    assert value(spark, refs.reference_of(F.lit("http://purl.obolibrary.org/obo/CL_0000001"))) == "cl:0000001"
    assert value(spark, refs.reference_of(F.lit("http://purl.obolibrary.org/obo/CLO_0000001"))) == "clo:0000001"
    assert value(spark, refs.reference_of(F.lit("ftp://x"))) is None


def test_formats(spark):
    for n, text in ((0, "0"), (950, "950"), (1234, "1.2K"), (12_345, "12K"), (3_400_000, "3.4M"), (34_000_000, "34M"), (2000, "2K")):
        assert value(spark, formats.short_number(F.lit(n))) == text
    assert value(spark, formats.strip_prefix(F.lit("HGNC:5"), "HGNC:")) == "5" == value(spark, formats.strip_prefix(F.lit("5"), "HGNC:"))
    assert value(spark, formats.flag(F.lit(None).cast("boolean"))) == "false"
    assert [value(spark, confidence.text(F.lit(x).cast("double"))) for x in (0.999882, 0.0, None, 1.0)] == ["0.99988", "", "", "1.0"]


def test_registry():
    assert REGISTRY.normalize("HPO") == "hp" and REGISTRY.normalize("nope", strict=False) is None
    assert REGISTRY.problems("doid") == [] and "not canonical" in REGISTRY.problems("DO")[0]
    assert "skos" not in REGISTRY.buildable() and "mesh" in REGISTRY.buildable()
