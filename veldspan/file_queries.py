"""Registered queries over files, jobs and reports: sources read what is written here first, from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan import fixtures as fx
from veldspan import graph
from veldspan.functions.confidence import rounded
from veldspan.functions.refs import curie, normalized_curie, reference_of, uri_of
from veldspan.operators import assemble as asm
from veldspan.operators import counts, filters, infer, prioritize
from veldspan.plans import build as raw_database
from veldspan.plans import landscape
from veldspan.plans.config import Configuration, Input
from veldspan.queries import _exact_both_ways, _graph, _number, _stars, _terms, summed
from veldspan.schema import TRIPLE
from veldspan.sinks import files as file_sinks
from veldspan.sinks import sssom
from veldspan.sources import files as file_sources
from veldspan.sources import tables
from veldspan.sources.catalog import CATALOG
from veldspan.sources.sssom import read_sssom
from veldspan.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _at(spark: SparkSession, label: str) -> str:
    return Workspace(spark, label).path


def _parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns in SQL over ``k``, a part's number."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")).selectExpr(*columns)


def _written(df: DataFrame, label: str, *, sep: str = "\t", header: bool = False) -> str:
    at = f"{_at(df.sparkSession, label)}/lines"
    df.write.option("sep", sep).option("header", str(header).lower()).csv(at)
    return at


def _facts(rows: DataFrame) -> DataFrame:
    return rows.select(*TRIPLE, "justification", rounded("confidence").alias("confidence"))


# sources


@query
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{_at(spark, 'parquet')}/rows"
    file_sinks.write_parquet(fx.rows(spark, sf_dir), at, "s_prefix")
    return summed(file_sources.read_parquet(spark, at))


@query
def nested_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To mappings with their evidence as an array, and back."""
    return summed(asm.flat(asm.nested(asm.deduplicate_evidence(fx.rows(spark, sf_dir)))))


@query
def digraph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.rows(spark, sf_dir)
    return summed(graph.from_digraph(graph.digraph(rows.where("s_prefix <> 'umls'")), rows))


@query
def sssom_gzip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compressed file with labels and licences, written and read back."""
    at = _at(spark, "sssom")
    rows = asm.deduplicate_evidence(fx.rows(spark, sf_dir))
    sssom.write_sssom(rows, f"{at}/all.sssom.tsv.gz", set_id="https://example.org/all", labels=fx.labels(spark, sf_dir), sets=fx.mapping_sets(spark), compress=True)
    return summed(read_sssom(spark, f"{at}/all.sssom.tsv.gz")[0])


@query
def sssom_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a reader turns down: unknown prefixes, no predicate, confidences out of range."""
    lines = _parts(
        spark, sf_dir, "concat(CASE WHEN k % 5 = 0 THEN 'nowhere' ELSE 'doid' END, ':', k) AS subject_id", "CASE WHEN k % 7 > 0 THEN 'skos:exactMatch' END AS predicate_id",
        "concat('mesh:D', k) AS object_id", "'semapv:ManualMappingCuration' AS mapping_justification", "CASE WHEN k % 11 = 0 THEN '1.5' ELSE '0.5' END AS confidence",
    )
    return read_sssom(spark, _written(lines, "rejected", header=True))[2].select("subject_id", "predicate_id", "object_id", "confidence")


@query
def ontology_xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-references to one vocabulary; those off its pattern go."""
    at = f"{_at(spark, 'xrefs')}/xrefs"
    _parts(
        spark, sf_dir, "'DO' AS s_prefix", "CAST(k AS STRING) AS s_id", "'oboinowl:hasDbXref' AS p", "CASE WHEN k % 3 = 0 THEN 'umls' ELSE 'mesh' END AS o_prefix",
        "CASE WHEN k % 7 = 0 THEN concat('x', k) WHEN k % 3 = 0 THEN concat('C', k) ELSE concat('D', k) END AS o_id",
    ).write.parquet(at)
    return _facts(file_sources.read_xrefs(spark, at, target="mesh", confidence=0.9))


@query
def lexical_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _parts(spark, sf_dir, "CASE WHEN k % 4 = 0 THEN 'zzz' ELSE 'DO' END AS sp", "CAST(k AS STRING) AS si", "'name' AS sn", "'mesh' AS tp", "concat('D', k) AS ti")
    return _facts(CATALOG.get("lexical")(spark, _written(lines, "lexical")))


@query
def family_equivalences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-mining names and families of families go."""
    lines = _parts(
        spark, sf_dir, "CASE k % 4 WHEN 0 THEN 'MEDSCAN' WHEN 1 THEN 'NXP' WHEN 2 THEN 'GO' ELSE 'reactome' END AS tp",
        "CASE k % 4 WHEN 1 THEN concat('FA:', k) WHEN 2 THEN lpad(CAST(k AS STRING), 7, '0') ELSE concat('R-HSA-', k) END AS ti", "concat('family_', k) AS si",
    )
    return _facts(CATALOG.get("fplx")(spark, _written(lines, "families", sep=",")))


@query
def thesaurus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four tables of the thesaurus, one with its columns turned and one with a header."""
    code = "concat('C', k) AS ncit"
    frames = {
        "hgnc": ("k < 100000", code, "concat('HGNC:', k) AS hgnc"), "go": ("true", "concat('GO:', lpad(CAST(k AS STRING), 7, '0')) AS go", code),
        "chebi": ("true", code, "concat('CHEBI:', k) AS chebi"), "uniprot": ("true", code, "concat('P', lpad(CAST(k AS STRING), 6, '0')) AS uniprot"),
    }
    out = None
    for kind, (where, *columns) in frames.items():
        df = _parts(spark, sf_dir, "k").where(where).selectExpr(*columns)
        one = _facts(CATALOG.get(f"ncit_{kind}")(spark, _written(df, f"thesaurus-{kind}", header=kind == "uniprot")))
        out = one if out is None else out.unionByName(one)
    return out


@query
def gene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, lines without one of the identifiers, up to two mappings a line."""
    lines = _parts(
        spark, sf_dir, "CASE WHEN k % 10 = 0 THEN concat('# ', k) ELSE CAST(100000 + k AS STRING) END AS id", "'gene' AS type", "CASE WHEN k % 3 > 0 THEN CAST(k AS STRING) END AS entrez", "'X' AS symbol",
        "CASE WHEN k % 4 > 0 THEN concat('ENSG', lpad(CAST(k AS STRING), 11, '0')) END AS ensembl",
    )
    return _facts(CATALOG.get("omim")(spark, _written(lines, "genes")))


@query
def compound_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the headings lack go."""
    lines = _parts(spark, sf_dir, "k AS cid", "concat('name ', k % 50) AS name")
    headings = _parts(spark, sf_dir, "concat('name ', k) AS name", "concat('D', k) AS id").where("length(id) = 3")
    return _facts(tables.compound_names(spark, _written(lines, "compounds"), headings))


@query
def clinical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources by name; others go."""
    lines = _parts(
        spark, sf_dir, "concat('DOID:', k) AS DO_ID", "element_at(array('MESH', 'ICD10CM', 'SNOMEDCT_US_2016_03_01', 'OTHER'), CAST(1 + k % 4 AS INT)) AS resource",
        "element_at(array(concat('D', k), concat('A', lpad(CAST(k % 100 AS STRING), 2, '0')), CAST(k AS STRING), 'x'), CAST(1 + k % 4 AS INT)) AS resource_ID",
    )
    return _facts(CATALOG.get("clinical pairs")(spark, _written(lines, "clinical", header=True)))


@query
def clinical_triangles_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other direction of the triangles: the pair without the code is the chained one."""
    lines = _parts(spark, sf_dir, "concat(k, '.0') AS SNOMEDCT_ID", "CASE WHEN k % 3 > 0 THEN concat('A', lpad(CAST(k % 100 AS STRING), 2, '0')) ELSE 'bad code' END AS ICD10CM_ID", "concat('D', k) AS MESH_ID")
    return _facts(CATALOG.get("clinical triangles via icd10cm")(spark, _written(lines, "triangles", header=True)))


@query
def pathway_equivalences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _parts(
        spark, sf_dir, "CASE WHEN k % 2 = 0 THEN 'KEGG' ELSE 'Reactome' END AS `Source Resource`", "CASE WHEN k % 2 = 0 THEN concat('path:hsa', lpad(CAST(k AS STRING), 5, '0')) ELSE concat('R-HSA-', k) END AS `Source ID`",
        "CASE WHEN k % 5 = 0 THEN 'isPartOf' ELSE 'equivalentTo' END AS `Mapping Type`", "'WikiPathways' AS `Target Resource`", "concat('WP', k) AS `Target ID`",
    )
    return _facts(CATALOG.get("pathways")(spark, _written(lines, "pathways", sep=",", header=True)))


@query
def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two properties of items, one of which is no vocabulary; properties of properties go, and literal prefixes too."""
    at = _at(spark, "properties")
    records = _parts(spark, sf_dir, "k DIV 1000 AS part", "struct(concat(CASE WHEN k % 6 = 0 THEN 'P' ELSE 'Q' END, k) AS wikidata_id, concat(CASE WHEN k % 2 = 0 THEN 'GO_' ELSE '' END, lpad(CAST(k AS STRING), 7, '0')) AS id) AS r")
    arrays = records.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value"))  # a thousand records a file
    for name in ("go", "doi"):
        arrays.write.partitionBy("part").text(f"{at}/{name}")
    return _facts(tables.all_property_values(spark, {name: f"{at}/{name}" for name in ("go", "doi")}))


@query
def catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources by their names, as one; curated rows take the set that they are given."""
    at = _at(spark, "catalog")
    file_sinks.write_jsonl(fx.rows(spark, sf_dir, "l_linenumber = 1"), f"{at}/rows.jsonl")
    file_sinks.write_parquet(fx.rows(spark, sf_dir, "l_linenumber = 2"), f"{at}/rows.parquet")
    rows = CATALOG.load_all(spark, {"get_jsonl_mappings": f"{at}/rows.jsonl", "parquet": f"{at}/rows.parquet"})
    return tables.curated(rows, "curated").groupBy("ms_id", "s_prefix", "o_prefix").agg(F.count("*").alias("n"))


@query
def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CURIEs made canonical, expanded, and read back from their URIs."""
    own = _parts(spark, sf_dir, "k", "concat(element_at(array('DO', 'mesh', 'nowhere', 'UMLS'), CAST(1 + k % 4 AS INT)), ':', CASE WHEN k % 9 = 0 THEN 'a:b' ELSE CAST(k AS STRING) END) AS text")
    own = own.withColumn("curie", normalized_curie("text")).withColumn("uri", uri_of("curie"))
    return own.select("k", "curie", "uri", reference_of("uri").alias("back"))


# jobs


def _job(spark: SparkSession, sf_dir: str, **more) -> Configuration:
    at = _at(spark, "job")
    file_sinks.write_parquet(fx.rows(spark, sf_dir, "l_linenumber <= 3"), f"{at}/one.parquet")
    file_sinks.write_jsonl(fx.rows(spark, sf_dir, "l_linenumber > 3"), f"{at}/two.jsonl")
    file_sinks.write_parquet(fx.rows(spark, sf_dir, fx.NEGATIVE), f"{at}/wrong.parquet")
    job = Configuration(
        "Fixture", "fixture", [Input("parquet", f"{at}/one.parquet"), Input("jsonl", f"{at}/two.jsonl")], f"{at}/levels", priority=fx.PRIORITY,
        negative_inputs=[Input("parquet", f"{at}/wrong.parquet")], **more,
    )
    return Configuration.from_json(job.to_json())


@query
def job_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declarative job from its JSON: two inputs, a negative one; the processed level as it is cached."""
    job = _job(spark, sf_dir)
    job.assemble(spark)
    return summed(job.read(spark, "processed"), once=True)


@query
def job_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = _job(spark, sf_dir)
    return summed(job.load_raw(spark))


@query
def job_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes kept before and removed after, without chains to speak of: two vocabularies."""
    job = _job(spark, sf_dir, keep_prefixes=["doid", "mesh"], post_remove_prefixes=["efo"])
    return summed(job.assemble(spark, write=False).processed)


@query
def raw_database_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources into partitions of one folder; one fails and is reported."""

    def fail() -> DataFrame:
        raise OSError("down")

    tasks = [("custom", f"line{k}", lambda k=k: fx.rows(spark, sf_dir, f"l_linenumber = {k}")) for k in (1, 2, 3)]
    rows, summary = raw_database.build(spark, _at(spark, "database"), [*tasks, ("custom", "down", fail)])
    by = rows.groupBy("key").agg(F.countDistinct("s_id").alias("subjects"))
    return summary.join(by, "key", "left").select("kind", "key", "cached", F.col("error").isNotNull().alias("failed"), "n", "subjects")


# reports


@query
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts between vocabularies, of raw and symmetric mappings and of the star graph."""
    stars = Workspace(spark, "stars").save(_stars(spark, sf_dir), "stars")
    over = landscape.overlaps(fx.rows(spark, sf_dir), _exact_both_ways(spark, sf_dir), stars, fx.PRIORITY, *_terms(spark, sf_dir))
    out = over.raw.withColumn("level", F.lit("raw"))
    for name in ("processed", "priority"):
        out = out.unionByName(getattr(over, name).withColumn("level", F.lit(name)))
    return out


@query
def meta_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each of two domains, over the same terms."""
    rows, terms = fx.rows(spark, sf_dir), _terms(spark, sf_dir)
    return landscape.meta_analysis({"all": landscape.analyze(rows, fx.PRIORITY, *terms), "pair": landscape.analyze(rows, fx.PRIORITY[:2], *terms)})


@query
def upset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts by the vocabularies that have them, a column each."""
    return landscape.analyze(fx.rows(spark, sf_dir), fx.PRIORITY, *_terms(spark, sf_dir)).upset()


@query
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.source_summary(landscape.summary_frame([*fx.PRIORITY, "ncit", "hp"], *_terms(spark, sf_dir)))


@query
def repeated_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prioritize.repeated_subjects(fx.rows(spark, sf_dir))


@query
def star_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star graph's rows with the places that they are sorted by."""
    stars = Workspace(spark, "stars").save(_stars(spark, sf_dir), "stars")
    return prioritize.in_order(stars, fx.PRIORITY).select("s_prefix", "s_id", "o_prefix", "o_id", prioritize._position(fx.PRIORITY, "o_prefix").cast("long").alias("place"))


@query
def anti_negative_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(filters.drop_triples(fx.rows(spark, sf_dir), fx.negatives(spark, sf_dir), symmetric=True))


@query
def reasoned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived mappings in exchange form: labels looked up, a licence of their own, what they derive from."""
    rows = infer.flip(asm.assemble(fx.rows(spark, sf_dir)))
    return sssom.sssom_rows(rows, fx.labels(spark, sf_dir), fx.mapping_sets(spark)).drop("record_id", "author_id", "comment")


# the property graph as files, and lookups


def _graph_files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    at = _at(spark, "graph")
    one = graph.build(fx.rows(spark, sf_dir), fx.mapping_sets(spark), names=fx.labels(spark, sf_dir), ws=Workspace(spark, "graph"))
    file_sinks.write_property_graph(one, at)
    return spark.read.option("sep", "\t").option("header", "true").csv(f"{at}/{name}")


@query
def mapping_edge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _graph_files(spark, sf_dir, "mapping_edges")
    return df.select(
        F.col(":START_ID").alias("start"), F.col(":TYPE").alias("type"), F.col(":END_ID").alias("end"), F.col("`confidence:double`").try_cast("double").alias("confidence"),
        F.col("`primary:boolean`").alias("primary"), F.col("`secondary:boolean`").alias("secondary"), F.col("`tertiary:boolean`").alias("tertiary"), F.col("`mapping_sets:string[]`").alias("mapping_sets"),
    )


@query
def concept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _graph_files(spark, sf_dir, "concept_nodes")
    return df.select(F.col("`curie:ID`").alias("curie"), "prefix", F.coalesce("name", F.lit("")).alias("name"), F.col("`priority:boolean`").alias("priority"))


@query
def cytoscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements for a graph viewer, parsed again."""
    data = F.from_json("json", "data struct<id string, label string, source string, target string, predicate string>")
    return _graph(spark, sf_dir).cytoscape("mesh:10-0", 3).select(data.alias("x")).select("x.data.*")


@query
def mapping_set_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(_graph(spark, sf_dir).mapping_set("set-O")).select("curie", "id", "title", "confidence")


@query
def example_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.example_concept().unionByName(g.concept_name("umls:10-1"))


@query
def evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence's id leads to one record, whose facts come back by it."""
    g = _graph(spark, sf_dir)
    ids = g.edges.where("type = 'hasEvidence'").select(F.col("end").alias("curie"))
    return g.evidence.join(ids, "curie").groupBy("mapping_justification").agg(F.count("*").alias("n"), F.count_distinct("curie").alias("n_ids"))


@query
def pairs_of_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remappings as CURIE pairs, one for each subject."""
    stars = Workspace(spark, "stars").save(_stars(spark, sf_dir), "stars")
    return prioritize.remapping(stars)


@query
def written_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mappings marked as wrong, appended to a table of negatives, are taken out."""
    at = f"{_at(spark, 'negatives')}/wrong.parquet"
    rows = fx.rows(spark, sf_dir, "l_orderkey < 400")
    for subject, predicate, obj in (("mesh:10-0", "skos:exactMatch", "doid:10-0"), ("doid:10-1", "skos:exactMatch", "umls:10-0")):
        file_sinks.append_negative(spark, at, subject, predicate, obj, author="orcid:1")
    left = filters.drop_triples(rows, file_sources.read_parquet(spark, at), symmetric=True)
    return summed(left.where("s_id LIKE '10-%'")).select(curie("s_prefix", "s_id").alias("subject"), "p", curie("o_prefix", "o_id").alias("object"), "confidence", "n_evidence")


@query
def observed_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each mapping set, most first, as the reports list them."""
    return counts.by_source(fx.rows(spark, sf_dir))
