from __future__ import annotations

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.data import B, EXACT, A, ref, row, rows, triples
from veldspan import graph
from veldspan.operators import infer
from veldspan.operators.assemble import assemble
from veldspan.operators.chains import infer_chains
from veldspan.plans.build import build, tabulate
from veldspan.plans.config import Configuration, Input
from veldspan.schema import CHAIN, DB_XREF, LEXICAL, MANUAL, MAPPING_SETS_SCHEMA, UNSPECIFIED
from veldspan.sinks.files import append_negative, write_jsonl, write_parquet, write_property_graph
from veldspan.sinks.sssom import write_sssom
from veldspan.sources import files, tables
from veldspan.sources.catalog import CATALOG
from veldspan.sources.sssom import read_sssom
from veldspan.streaming import ingest

M1, M2 = "mesh:C406527", "chebi:101854"
CHEMBL = "chembl.compound:CHEMBL459505"


@pytest.fixture
def drug(spark):
    """Three mappings: three evidences, one, and one chained from both."""
    simple = rows(
        spark, row(M1, EXACT, M2, 0.99, justification=MANUAL, author="0000-0003-0000-0001", ms_id="curated"), row(M1, EXACT, M2, 0.94, justification=MANUAL, author="0000-0003-0000-0002", ms_id="curated"),
        row(M1, EXACT, M2, 0.8, justification=LEXICAL, ms_id="lexical"), row(M2, EXACT, CHEMBL, 0.9, justification=UNSPECIFIED, ms_id="chembl"),
    )
    return simple, infer_chains(simple.unionByName(infer.flip(simple)), backwards=True)


@pytest.fixture
def sets(spark):
    data = [("curated", "Curated", "cc0", "1", 0.99, None), ("lexical", "lexical", None, None, 0.9, "mesh"), ("chembl", "chembl", None, None, None, "chebi")]
    return spark.createDataFrame(data, MAPPING_SETS_SCHEMA)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("compress", [False, True])
def test_jsonl_round_trip(spark, tmp_path, drug, compress):
    rows_ = assemble(drug[1])
    write_jsonl(rows_, f"{tmp_path}/x.jsonl", compress=compress)
    assert same(files.read_jsonl(spark, f"{tmp_path}/x.jsonl"), rows_)
    (tmp_path / "bad.jsonl").write_text('{"s_prefix": 1\n')
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).isEmpty()
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), strict=True).collect()


def test_parquet_round_trip(spark, tmp_path, drug):
    write_parquet(drug[1], f"{tmp_path}/x.parquet")
    assert same(files.read_parquet(spark, f"{tmp_path}/x.parquet"), drug[1])
    assert same(files.read_first(spark, f"{tmp_path}/none.parquet", f"{tmp_path}/x.parquet"), drug[1])
    with pytest.raises(ValueError, match="none of these"):
        files.read_first(spark, f"{tmp_path}/none.parquet")


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("prune", [False, True])
def test_sssom_round_trip(spark, tmp_path, drug, compress, prune):
    path = f"{tmp_path}/x.sssom.tsv" + ".gz" * compress
    simple = assemble(drug[0])
    write_sssom(simple, path, set_id="https://example.org/x.sssom.tsv", prune=prune, compress=compress)
    text = (gzip.open if compress else open)(path, "rt").read()
    assert text.startswith("#curie_map:\n#  chebi: http") and "#mapping_set_id: https://example.org/x.sssom.tsv\n" in text
    assert ("comment" in text) == (not prune)
    back, _, rejected = read_sssom(spark, path)
    assert rejected.isEmpty() and same(back.drop("ms_id"), simple.drop("ms_id"))
    assert {r.ms_id for r in back.collect()} == {"https://example.org/x.sssom.tsv"}


def test_sssom_text(spark, tmp_path):
    df = infer_chains(rows(spark, row("mesh:C027957", EXACT, "chebi:133530"), row("chebi:133530", EXACT, "cas:30223-92-8")), backwards=False).where(F.col("justification") == CHAIN)
    labels = spark.createDataFrame([("mesh", "C027957", "tyramine O-sulfate"), ("cas", "30223-92-8", "Tyramine sulfate")], "prefix string, id string, name string")
    write_sssom(df, f"{tmp_path}/x.tsv", set_id="https://example.org/test.sssom.tsv", labels=labels)
    head, names, line = (tmp_path / "x.tsv").read_text().split("\n")[:-3], *(tmp_path / "x.tsv").read_text().split("\n")[-3:-1]
    assert head == [
        "#curie_map:", "#  cas: https://commonchemistry.cas.org/detail?cas_rn=", "#  mesh: https://meshb.nlm.nih.gov/record/ui?ui=", "#  semapv: https://w3id.org/semapv/vocab/",
        "#  skos: http://www.w3.org/2004/02/skos/core#", "#mapping_set_id: https://example.org/test.sssom.tsv",
    ]
    got = dict(zip(names.split("\t"), line.split("\t"), strict=True))
    assert got["comment"] == "mesh:C027957 chebi:133530 cas:30223-92-8"
    assert got["derived_from"] == "mapping:ba04ff1967c311ddb2e8d1ee5eecff61d5e993f4128270464242abca4bb188b4|mapping:a0022401f47964288ecc1ab706d79b4d4abc10edf33d0a71953834a0b0b3c24c"
    assert got["license"].endswith("zero/1.0/") and got["derived_from"].count("mapping:") == 2 and "Tyramine sulfate" in line


def test_sssom_rows_are_checked(spark, tmp_path):
    lines = [
        "#mapping_set_id: https://example.org/a", "#mapping_set_title: A", "#mapping_set_confidence: 0.5", "subject_id\tpredicate_id\tobject_id\tmapping_justification\tconfidence\tmapping_source",
        "DOID:1\tskos:exactMatch\tmesh:D1\tsemapv:ManualMappingCuration\t0.9\t", "doid:2\tskos:exactMatch\tMESH:D2\tsemapv:ManualMappingCuration\t\t",
        "doid:3\tskos:exactMatch\tmesh:D3\tsemapv:ManualMappingCuration\t\tother", "nope:3\tskos:exactMatch\tmesh:D3\tsemapv:ManualMappingCuration\t\t", "doid:4\tskos:exactMatch\tmesh:D3\tsemapv:ManualMappingCuration\tmuch\t",
    ]
    path = tmp_path / "a.tsv"
    path.write_text("\n".join(lines) + "\n")
    got, sets, rejected = read_sssom(spark, str(path))
    assert {(r.s_id, r.confidence, r.ms_id) for r in got.collect()} == {("1", 0.9, "https://example.org/a"), ("2", 0.5, "https://example.org/a"), ("3", None, "other")}
    assert {r.ms_id: r.title for r in sets.collect()} == {"https://example.org/a": "A", "other": None} and rejected.count() == 2
    with pytest.raises(ValueError, match="invalid row"):
        read_sssom(spark, str(path), strict=True)


def test_property_graph(spark, tmp_path, drug, sets):
    chained = drug[1].where(f"justification <> '{'semapv:MappingInversion'}'").where("s_prefix <> 'chembl.compound'")
    labels = spark.createDataFrame([("mesh", "C406527", "R 115866"), ("chebi", "101854", "talarozole")], "prefix string, id string, name string")
    g = graph.build(chained, sets, names=labels)
    nodes = {r.curie[8:16]: r for r in g.mapping_nodes.collect()}
    assert (nodes["eacc57c4"].confidence, nodes["eacc57c4"].tertiary) == ("0.99988", False)
    assert {r.curie: r.name for r in g.concepts.collect() if r.prefix in ("mesh", "orcid")} == {M1: "R 115866", "orcid:0000-0003-0000-0001": "", "orcid:0000-0003-0000-0002": ""}
    edges = {r.end: r for r in g.mapping_edges.collect() if r.start == M1}
    assert edges[M2].mapping_sets == "Curated|lexical" and edges[M2].primary and not edges[M2].secondary
    kinds = {r.type: r["count"] for r in g.edges.groupBy("type").count().collect()}
    assert kinds["hasAuthor"] == 2 and kinds["fromSet"] == 4 and kinds["hasEvidence"] == chained.count()
    write_property_graph(g, f"{tmp_path}/pg", compress=False)
    back = spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/pg/concept_nodes")
    assert back.columns == ["curie:ID", "prefix", "name", "priority:boolean"] and back.count() == g.concepts.count()
    assert {r.curie for r in g.exact_matches(M1, 1).collect()} >= {M2}
    assert g.mapping(next(r.curie for r in g.mapping_nodes.collect() if "eacc57c4" in r.curie)).count() == 3
    g.register()
    assert spark.sql("SELECT count(*) FROM concepts").first()[0] == g.concepts.count()
    assert g.example_concept().first().curie == M2 and g.concept_name(M2).first().name == "talarozole"
    assert [r.curie for r in g.autocomplete("talarozol").collect()] == [M2] == [r.curie for r in g.autocomplete("talarozole1").collect()]
    assert set(g.full_summary()) >= {"node_counts", "author_counts"}


def test_digraph_round_trip(spark, drug):
    df = drug[1]
    assert same(graph.from_digraph(graph.digraph(df), df), df)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tables(spark, tmp_path):
    lex = write(tmp_path / "lex.tsv", "MESH\tD1\tname\tDOID\t5\nnope\tD1\tname\tDOID\t5\n")
    assert triples(tables.lexical_table(spark, lex)) == {("mesh:D1", EXACT, "doid:5")}
    fam = write(tmp_path / "fam.csv", "MEDSCAN,x,A\nBEL,y,A\nNXP,FA:1,A\nHGNC,5,A\nGO,0000001,B\n")
    assert triples(tables.family_equivalences(spark, fam)) == {("fplx:A", EXACT, "hgnc:5"), ("fplx:B", EXACT, "go:0000001")}
    hgnc = write(tmp_path / "h.tsv", "C1\tHGNC:5\nC2\tHGNC:x\n")
    assert triples(tables.thesaurus_pairs(spark, hgnc, "hgnc")) == {("ncit:C1", EXACT, "hgnc:5")}
    go = write(tmp_path / "g.tsv", "GO:0000001\tC1\n")
    assert triples(tables.thesaurus_pairs(spark, go, "go")) == {("ncit:C1", EXACT, "go:0000001")}
    up = write(tmp_path / "u.tsv", "NCIt Code\tSwissProt ID\tmore\nC1\tP12345\tz\n")
    assert triples(tables.thesaurus_pairs(spark, up, "uniprot")) == {("ncit:C1", EXACT, "uniprot:P12345")}
    gene = write(tmp_path / "gene.tsv", "# a\n# b\n100050\tgene\t1\tA\tENSG00000000001\n100051\tgene\t\tB\t\n100052\tgene\t7\tC\t\n")
    assert triples(tables.gene_table(spark, gene)) == {("omim:100050", EXACT, "ncbigene:1"), ("omim:100050", EXACT, "ensembl:ENSG00000000001"), ("omim:100052", EXACT, "ncbigene:7")}
    headings = spark.createDataFrame([("Aspirin", "D001241")], "name string, id string")
    comp = write(tmp_path / "c.tsv", "2244\tAspirin\n1\tUnknown\n")
    assert triples(tables.compound_names(spark, comp, headings)) == {("pubchem.compound:2244", EXACT, "mesh:D001241")}
    pairs = write(tmp_path / "p.tsv", "DO_ID\tDO name\tresource\tresource_ID\nDOID:5\tx\tMESH\tD1\nDOID:6\tx\tICD10CM\tbad\n")
    assert triples(tables.clinical_pairs(spark, pairs)) == {("doid:5", EXACT, "mesh:D1")}
    tri = write(tmp_path / "t.tsv", "SNOMEDCT_ID\tn\tICD10CM_ID\tm\tMESH_ID\n123.0\tx\tA01\ty\tD1\n124\tx\t\ty\tD2\n")
    got = {(r.s_prefix, r.s_id, r.o_prefix, r.o_id, r.justification) for r in tables.clinical_triangles(spark, tri, "snomedct").collect()}
    assert got == {("mesh", "D1", "snomedct", "123", UNSPECIFIED), ("mesh", "D1", "icd10cm", "A01", CHAIN), ("icd10cm", "A01", "snomedct", "123", UNSPECIFIED), ("mesh", "D2", "snomedct", "124", UNSPECIFIED)}
    path = write(tmp_path / "w.csv", "Source Resource,Source ID,Mapping Type,Target Resource,Target ID\nkegg,path:hsa00010,equivalentTo,reactome,R-HSA-1\nkegg,path:hsa00011,isPartOf,reactome,R-HSA-2\n")
    assert triples(tables.pathway_equivalences(spark, path)) == {("kegg.pathway:hsa00010", EXACT, "reactome:R-HSA-1")}
    props = write(tmp_path / "q.json", json.dumps([{"wikidata_id": "Q1", "id": "BTO_0000001"}, {"wikidata_id": "P1", "id": "0000002"}, {"wikidata_id": "Q2", "id": "no"}]))
    assert triples(tables.property_values(spark, props, "bto")) == {("wikidata:Q1", EXACT, "bto:0000001")}
    assert triples(tables.all_property_values(spark, {"bto": props, "doi": props})) == {("wikidata:Q1", EXACT, "bto:0000001")}


def test_messy_references(spark):
    text = "RRID:CVCL_0001; COSMICID: 905933, ACC 123); JHSF:JCRB0403, ATCC CRL-1658; DSMZ:ACC5; bto:BAO_0000001; LINCS_HMS:50; omim:100050; nonsense; chembl.cell:CHEMBL33"
    nodes = spark.createDataFrame([("0000001", text)], "id string, value string")
    assert triples(tables.cell_line_xrefs(nodes)) == {
        ("clo:0000001", DB_XREF, x)
        for x in ("cellosaurus:0001", "cosmic.cell:905933", "dsmz:ACC123", "jcrb:JCRB0403", "atcc:CRL-1658", "dsmz:ACC-5", "bao:0000001", "hms.lincs.cell:50", "chembl.cell:CHEMBL33")
    }


def test_marking_a_mapping_as_wrong(spark, tmp_path):
    path = f"{tmp_path}/negatives"
    for x in ("mesh:D1", "mesh:D2"):
        append_negative(spark, path, "doid:1", EXACT, x, author="0000-0000-0000-0001")
    assert triples(files.read_parquet(spark, path)) == {("doid:1", EXACT, "mesh:D1"), ("doid:1", EXACT, "mesh:D2")}


def test_catalog():
    assert CATALOG.normalize("get_gene-table_mappings") == "gene_table"
    with pytest.raises(KeyError):
        CATALOG.get("nothing")


def test_job(spark, tmp_path):
    a1, b1 = ref(A, 1), ref(B, 1)
    raw = rows(spark, row(a1, DB_XREF, b1), row(b1, EXACT, "hp:0000003"), row("hp:0000003", EXACT, "doid:9"), row(a1, EXACT, "mesh:D5"))
    write_parquet(raw, f"{tmp_path}/in")
    write_parquet(rows(spark, row(a1, EXACT, "mesh:D5")), f"{tmp_path}/negative")
    seen = []
    job = Configuration(
        "Test job", "test", [Input("parquet", f"{tmp_path}/in")], f"{tmp_path}/out", priority=[A, B, "hp"], negative_inputs=[Input("parquet", f"{tmp_path}/negative")],
        mutations=[infer.Mutation(A, B)], post_remove_prefixes=["doid"], hooks=[lambda c, p: seen.append(c.key)],
    )
    pack = job.assemble(spark)
    assert triples(pack.priority) == {(b1, EXACT, a1), ("hp:0000003", EXACT, a1)} and seen == ["test"]
    assert DB_XREF not in {p for _, p, _ in triples(pack.processed)} and not any("doid" in x[0] or "mesh" in x[2] for x in triples(pack.processed))
    assert triples(job.read(spark, "priority")) == triples(pack.priority)
    again = Configuration.from_json(job.to_json())
    assert triples(again.assemble(spark).priority) == triples(pack.priority)
    terms = spark.createDataFrame([(A, "0000001"), (A, "0000002")], "prefix string, id string")
    stats = job.summarize(pack, terms)
    assert (stats["at_least_1"], stats["only_1"], stats["total"]) == (1, 1, 4) and stats["priority_mappings"] == 2
    job.write_exports(spark, pack)
    assert os.path.exists(f"{tmp_path}/out/processed.sssom.tsv") and os.path.isdir(f"{tmp_path}/out/graph/edges")
    with pytest.raises(ValueError, match="not canonical"):
        Configuration("x", "x", [], "", keep_prefixes=["DO"])


def test_build_keeps_failures_apart(spark, tmp_path):
    good = rows(spark, row("doid:1", EXACT, "mesh:D1"))

    def bad():
        raise OSError("down")

    out, summary = build(spark, str(tmp_path), [("ontology", "doid", lambda: good), ("custom", "x", bad)])
    assert triples(out) == {("doid:1", EXACT, "mesh:D1")} and {r.key: r.error for r in summary.collect()} == {"doid": None, "x": "OSError: down"}
    _, again = build(spark, str(tmp_path), [("ontology", "doid", bad)])
    assert [(r.key, r.cached, r.n) for r in tabulate(again).collect()] == [("doid", True, 1)]


def test_stream_ingests_each_evidence_once(spark, tmp_path):
    store, source = f"{tmp_path}/store", f"{tmp_path}/in"
    one, two = row("doid:1", EXACT, "mesh:D1"), row("doid:2", EXACT, "mesh:D2")
    rows(spark, one, one).write.parquet(f"{source}/a")
    rows(spark, one, two).write.mode("append").parquet(f"{source}/a")
    for _ in range(2):
        ingest.ingest(ingest.stream_rows(spark, f"{source}/a", max_files=1), store, f"{tmp_path}/cp").awaitTermination()
        assert ingest.stored(spark, store).count() == 2
    ingest.append_batch(rows(spark, one, two), 99, store)
    assert ingest.stored(spark, store).count() == 2


def test_streams_with_two_checkpoints_share_a_store(spark, tmp_path):
    store = f"{tmp_path}/store"
    data = {k: [row(f"doid:{k}{i}", EXACT, f"mesh:D{i}") for i in range(1, 6)] for k in (1, 2)}
    for k, own in data.items():
        rows(spark, *own, data[1][0]).write.parquet(f"{tmp_path}/in{k}")
        ingest.ingest(ingest.stream_rows(spark, f"{tmp_path}/in{k}", max_files=1), store, f"{tmp_path}/cp{k}").awaitTermination()
    want = {("doid:11", EXACT, "mesh:D1")} | {(f"doid:{k}{i}", EXACT, f"mesh:D{i}") for k in data for i in range(1, 6)}
    assert triples(ingest.stored(spark, store)) == want and ingest.stored(spark, store).count() == len(want)
    # a batch that is written again, after a failure, changes nothing
    run = ingest._run_of(spark, f"{tmp_path}/cp2")
    for _ in range(2):
        ingest.append_batch(rows(spark, *data[2][:2]), 7, store, run)
    assert ingest.stored(spark, store).count() == len(want)


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.start.hour, r.kind, r.n) for r in ingest.windowed_counts(df).collect()) == [(0, "a", 2), (1, "b", 1)]


def test_domains(spark, tmp_path):
    from veldspan.plans import cli
    from veldspan.plans.domains import DOMAINS, configure

    for key in DOMAINS:
        configure(key, {}, str(tmp_path))  # all prefixes are canonical
    write_parquet(rows(spark, row("ccle:A", DB_XREF, "efo:0000001"), row("cl:0000001", DB_XREF, "ccle:A")), f"{tmp_path}/ccle")
    job = configure("cell", {"ccle": f"{tmp_path}/ccle"}, f"{tmp_path}/out", subsets={})
    pack = job.assemble(spark)
    assert (("ccle:A", EXACT, "efo:0000001")) in triples(pack.processed)
    assert triples(files.read_parquet(spark, f"{tmp_path}/out/ccle_efo.parquet")) == {("ccle:A", EXACT, "efo:0000001")}
    (tmp_path / "sources.json").write_text(json.dumps({"parquet": f"{tmp_path}/ccle"}))
    cli.main(["sources", f"{tmp_path}/sources.json", f"{tmp_path}/raw"])


def test_tabulate(spark):
    from veldspan.operators.counts import tabulate

    text = tabulate(rows(spark, row("doid:1", EXACT, "mesh:D1", 0.5), row("doid:1", EXACT, "mesh:D1", 0.9)))
    assert text.splitlines()[1:] == [f"doid:1 | {EXACT} | mesh:D1 | {UNSPECIFIED} | 0.5", f" |  |  | {UNSPECIFIED} | 0.9"]


def test_lookups_join_what_belongs_to_their_triples(spark, drug, sets):
    """of a graph of rows and of its stored frames the same, the former without joins of all edges."""
    from veldspan.workspace import Workspace

    labels = spark.createDataFrame([("mesh", "C406527", "R 115866"), ("chebi", "101854", "talarozole")], "prefix string, id string, name string")
    g = graph.build(drug[1], sets, names=labels)
    stored = graph.build(drug[1], sets, names=labels).save(Workspace(spark, "stored"))
    assert stored.rows is None and g.first_mapping() == stored.first_mapping()
    lookups = [lambda g: g.mappings_of_set("curated", 10), lambda g: g.mapping(g.first_mapping()), lambda g: g.mappings_by_confidence(0.9), lambda g: g.component(M1)[1]]
    for f in lookups:
        assert same(f(g), f(stored))
    # few triples are described, so no join of all edges is left in the plan
    assert any("veldspan-part" in f for f in g.example_mappings(5).inputFiles())


def test_lookups_go_on_where_the_first_ids_have_none(spark, drug, sets, monkeypatch):
    monkeypatch.setattr(graph, "FIRST", 1)
    labels = spark.createDataFrame([("mesh", "C406527", "R 115866"), ("chebi", "101854", "talarozole")], "prefix string, id string, name string")
    g = graph.build(drug[0], sets, names=labels)
    assert {r.subject for r in g.example_mappings(5).collect()} == {M1} and g.mappings_of_set("curated", 1).count() == 3


def test_a_concept_without_the_relation_has_no_component(spark, sets):
    """SQL has the concepts with an exact mapping; the start was listed without one."""
    g = graph.build(rows(spark, row(M1, DB_XREF, M2), row(M2, EXACT, CHEMBL)), sets)
    assert g.cytoscape(M1).isEmpty() and g.cytoscape(M2).count() == 3
