"""The registered queries: each applies one operator to the derived mapping table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan import fixtures as fx
from veldspan import graph
from veldspan.functions.confidence import noisy_or, rounded
from veldspan.functions.refs import curie, mapping_set_id, triple_id
from veldspan.operators import assemble as asm
from veldspan.operators import chains, components, counts, filters, hierarchy, infer, many, prioritize
from veldspan.plans import assembly, landscape
from veldspan.sinks import files as file_sinks
from veldspan.sinks import sssom
from veldspan.sources import files as file_sources
from veldspan.sources import tables
from veldspan.sources.sssom import read_sssom
from veldspan.streaming import ingest
from veldspan.schema import DB_XREF, EXACT, IMPRECISE, SAME_AS, SUBCLASS, TRIPLE
from veldspan.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def summed(rows: DataFrame, *, once: bool = False) -> DataFrame:
    """Distinct evidence summed up by triple; if ``once`` each comes once already."""
    return (rows if once else asm.confidences(rows)).groupBy(*TRIPLE).agg(rounded(noisy_or("confidence")).alias("confidence"), F.count("*").alias("n_evidence"))


def _filtered(name: str, f: Callable[[DataFrame, SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: summed(f(fx.rows(spark, sf_dir), spark, sf_dir))


_filtered("keep_prefixes", lambda m, s, d: filters.keep_prefixes(m, ["DO", "mesh"]))
_filtered("keep_subject_prefixes", lambda m, s, d: filters.keep_subject_prefixes(m, ["doid", "mesh"]))
_filtered("keep_object_prefixes", lambda m, s, d: filters.keep_object_prefixes(m, ["doid", "mesh"]))
_filtered("drop_prefixes", lambda m, s, d: filters.drop_prefixes(m, ["umls", "ncit"]))
_filtered("drop_self_matches", lambda m, s, d: filters.drop_self_matches(m))
_filtered("drop_imprecise", lambda m, s, d: filters.drop_imprecise(m))
_filtered("anti_negative", lambda m, s, d: filters.drop_triples(m, fx.negatives(s, d)))
_filtered("minimum_confidence", lambda m, s, d: filters.minimum_confidence(m, 0.95))
_filtered("minimum_mapping_confidence", lambda m, s, d: filters.minimum_confidence(asm.assemble(m), 0.95, assembled=True))
_filtered("subset_filter", lambda m, s, d: filters.keep_subsets(m, fx.subset_terms(s, d)))
_filtered("assemble", lambda m, s, d: m)
_filtered("reverse", lambda m, s, d: infer.reverse(asm.assemble(m)))
_filtered("mutate_add", lambda m, s, d: infer.mutate_dbxrefs(asm.assemble(m), {("doid", "mesh"): 0.99, ("umls", "efo"): 0.8}))
_filtered("mutate_mutual", lambda m, s, d: infer.mutate_mutual_dbxrefs(asm.assemble(m), ["doid", "mesh", "umls"], 0.95))
_filtered("mutate_replace", lambda m, s, d: infer.replace_predicates(asm.assemble(m), [infer.Mutation("doid", ["mesh", "efo"], 0.9), infer.Mutation("umls", confidence=0.9)]))
_filtered("many_to_many", lambda m, s, d: many.many_to_many(m))
_filtered("drop_many_to_many", lambda m, s, d: many.drop_many_to_many(m))


@query
def generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture has no strict predicates, so its imprecise ones stand in for them."""
    rows = fx.rows(spark, sf_dir).withColumn("p", F.when(F.col("p") == IMPRECISE[0], SUBCLASS).when(F.col("p") == IMPRECISE[1], SAME_AS).otherwise(F.col("p")))
    return summed(infer.generalize(asm.assemble(rows)))


@query
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asm.deduplicate_evidence(fx.rows(spark, sf_dir))
    return out.select(*TRIPLE, "justification", "author", rounded("row_confidence").alias("row_confidence"), rounded("confidence").alias("confidence"), "ms_id")


@query
def tier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asm.mappings(asm.assemble(fx.rows(spark, sf_dir)), fx.mapping_sets(spark))
    return out.select(*TRIPLE, "has_primary", "has_secondary", "has_tertiary")


@query
def mapping_set_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asm.mapping_set_titles(fx.rows(spark, sf_dir), fx.mapping_sets(spark))


@query
def flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.flip(asm.assemble(fx.rows(spark, sf_dir))).select(*TRIPLE, "confidence", F.col("derived_from")[0].alias("derived_from"))


@query
def project_1to1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return many.project(fx.rows(spark, sf_dir), "doid", "mesh")[0].select(*TRIPLE).distinct()


@query
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.violations(fx.rows(spark, sf_dir))


@query
def source_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.source_target_counts(fx.rows(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.identifier_index(fx.rows(spark, sf_dir), [EXACT, DB_XREF])


@query
def identifier_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query
def observed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.observed_terms(fx.rows(spark, sf_dir))


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.exact_terms(spark, sf_dir), counts.observed_terms(fx.rows(spark, sf_dir))


@query
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.term_counts(fx.PRIORITY, *_terms(spark, sf_dir))


@query
def symmetric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.symmetric_counts(_index(spark, sf_dir), fx.PRIORITY, *_terms(spark, sf_dir))


@query
def asymmetric_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.asymmetric_counts(counts.identifier_index(fx.rows(spark, sf_dir), [EXACT], directed=True))


@query
def counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pivot(symmetric_counts(spark, sf_dir), fx.PRIORITY)


def _symmetric_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact mappings and their inverses, assembled."""
    return asm.assemble(infer.reverse(asm.assemble(filters.with_predicates(fx.rows(spark, sf_dir), [EXACT]))))


@query
def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = counts.identifier_index(fx.rows(spark, sf_dir), [EXACT], directed=True)
    processed = counts.identifier_index(_symmetric_exact(spark, sf_dir), [EXACT], directed=True)
    return counts.gains(counts.asymmetric_counts(raw), counts.asymmetric_counts(processed))


@query
def unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.unobserved(fx.PRIORITY, *_terms(spark, sf_dir))


@query
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(fx.rows(spark, sf_dir))


QUERIES["components"] = QUERIES.pop("connected_components")


def _joined(sizes: DataFrame) -> DataFrame:
    return sizes.select(F.array_join("prefixes", ",").alias("prefixes"), "n")


@query
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(components.component_sizes(fx.rows(spark, sf_dir), fx.PRIORITY))


@query
def component_sizes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(components.component_sizes(fx.rows(spark, sf_dir)))


@query
def coverage_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.coverage_sizes(fx.rows(spark, sf_dir), fx.PRIORITY)


def _exact_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of exact mappings and their inverses; one may come several times."""
    rows = filters.with_predicates(fx.rows(spark, sf_dir), [EXACT])
    back = {"s_prefix": "o_prefix", "s_id": "o_id", "p": "p", "o_prefix": "s_prefix", "o_id": "s_id"}
    return rows.select(F.inline(F.array(F.struct(*TRIPLE), F.struct(*(F.col(of).alias(c) for c, of in back.items())))))


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star graph's triples."""
    exact = filters.with_predicates(fx.rows(spark, sf_dir), [EXACT])
    return prioritize.in_stars(_exact_both_ways(spark, sf_dir), prioritize.star_edges(exact, fx.PRIORITY)).distinct()


@query
def prioritized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stars(spark, sf_dir)


QUERIES["prioritize"] = QUERIES.pop("prioritized")


@query
def prioritize_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = Workspace(spark, "stars").save(_stars(spark, sf_dir), "stars")
    return prioritize.prioritize_column(stars, fx.lookup_frame(spark, sf_dir), column="curie")


@query
def equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prioritize.equivalence_classes(fx.rows(spark, sf_dir), _stars(spark, sf_dir))


@query
def update_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = Workspace(spark, "stars").save(_stars(spark, sf_dir), "stars")
    terms = fx.lexical_terms(spark, sf_dir).select(F.col("db").alias("prefix"), "id", "text")
    return prioritize.update_literals(terms, stars)


@query
def reprioritize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = Workspace(spark, "stars").save(_stars(spark, sf_dir), "stars")
    out = prioritize.reprioritize_terms(fx.lexical_terms(spark, sf_dir), stars)
    return out.select("text", "norm_text", "db", "id", "entry_name", "source_db", "source_id")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings without negatives and imprecise ones, summed up."""
    rows = filters.drop_triples(filters.drop_imprecise(fx.rows(spark, sf_dir)), fx.negatives(spark, sf_dir))
    return infer.with_confidence(asm.confidences(rows))


@query
def inferred_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chains add, and the inverses of it."""
    ws = Workspace(spark, "chains")
    edges = ws.save(infer.with_inverses(ws.save(_prepared(spark, sf_dir), "mappings")), "edges")
    paths = chains.chain_paths(edges, ws=ws, edges=edges)
    forward = paths.groupBy(*TRIPLE).agg(F.bool_or("known").alias("known"), F.count("*").alias("n_evidence"))
    inverse = F.when(F.col("p") == "skos:broadMatch", "skos:narrowMatch").when(F.col("p") == "skos:narrowMatch", "skos:broadMatch").otherwise(F.col("p"))
    back = forward.select(F.col("o_prefix").alias("s_prefix"), F.col("o_id").alias("s_id"), inverse.alias("p"), F.col("s_prefix").alias("o_prefix"), F.col("s_id").alias("o_id"), "known", F.lit(1).cast("long").alias("n_evidence"))
    return forward.unionByName(back).groupBy(*TRIPLE).agg(F.bool_or("known").alias("known"), F.sum("n_evidence").alias("n_evidence"))


QUERIES["chains"] = QUERIES.pop("inferred_chains")


@query
def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lit("region").alias("prefix"), F.col("r_regionkey").cast("string").alias("id"))
    return hierarchy.descendants(fx.hierarchy(spark, sf_dir), roots)


@query
def hydrated_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("supplier", "region", "1"), ("supplier", "region", "2"), ("region", "region", "3")], "prefix string, ref_prefix string, ref_id string")
    return hierarchy.hydrate_subsets(roots, fx.hierarchy(spark, sf_dir))


@query
def vocabulary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.vocabulary_terms(fx.exact_terms(spark, sf_dir), ["doid", "umls"], fx.subset_terms(spark, sf_dir))


@query
def summary_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = landscape.summary_frame(fx.PRIORITY, *_terms(spark, sf_dir), subset=fx.subset_terms(spark, sf_dir))
    return out.select("prefix", "status", "terms")


def _landscape(spark: SparkSession, sf_dir: str) -> landscape.Landscape:
    return landscape.analyze(fx.rows(spark, sf_dir), fx.PRIORITY, *_terms(spark, sf_dir))


@query
def landscape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landscape(spark, sf_dir).summary()


QUERIES["landscape"] = QUERIES.pop("landscape_summary")


@query
def landscape_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landscape(spark, sf_dir).distribution()


@query
def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw rows to processed mappings, as the flagship plan runs it."""
    return summed(assembly.process(fx.rows(spark, sf_dir), negatives=fx.negatives(spark, sf_dir)), once=True)


# the property graph


def _graph(spark: SparkSession, sf_dir: str, stars: bool = False) -> graph.PropertyGraph:
    priority_rows = Workspace(spark, "stars").save(_stars(spark, sf_dir), "stars") if stars else None
    return graph.build(fx.rows(spark, sf_dir), fx.mapping_sets(spark), priority_rows=priority_rows, names=fx.labels(spark, sf_dir))


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.expr("try_cast(confidence AS double)"))


@query
def triple_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.rows(spark, sf_dir).select(*TRIPLE).distinct().select(*TRIPLE, triple_id().alias("tid"))


@query
def concept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, stars=True).concepts


@query
def mapping_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(_graph(spark, sf_dir).mapping_nodes)


@query
def evidence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ids, whose hash SQL doesn't have."""
    return _number(_graph(spark, sf_dir).evidence).select("prefix", "type", "mapping_justification", "confidence")


@query
def mapping_set_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(_graph(spark, sf_dir).sets)


@query
def mapping_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(_graph(spark, sf_dir).mapping_edges)


@query
def annotated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges.where("type LIKE 'owl:%'")


@query
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges.groupBy("type").agg(F.count("*").alias("n"))


@query
def derived_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inverses are derived from, by triple."""
    rows = infer.flip(asm.assemble(fx.rows(spark, sf_dir)))
    g = graph.build(rows, fx.mapping_sets(spark))
    own = g.edges.where("type = 'hasEvidence'").select(F.col("start").alias("mapping"), F.col("end").alias("evidence"))
    return own.join(g.edges.where("type = 'derivedFromMapping'").select(F.col("start").alias("evidence"), F.col("end").alias("source")), "evidence").select("mapping", "source")


@query
def sssom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asm.deduplicate_evidence(fx.rows(spark, sf_dir))
    return sssom.sssom_rows(rows, fx.labels(spark, sf_dir), fx.mapping_sets(spark)).drop("record_id")


@query
def digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.digraph(fx.rows(spark, sf_dir))
    return out.select(*(c for c in TRIPLE if c != "p"), F.array_join("predicates", "|").alias("predicates"))


@query
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.negative_pairs(fx.negatives(spark, sf_dir))


def _counted(name: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: getattr(_graph(spark, sf_dir), name)()


for _name in ("predicate_counts", "justification_counts", "evidence_type_counts", "mapping_set_counts", "concept_counts", "author_counts"):
    _counted(_name)


@query
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, stars=True).node_counts()


@query
def highest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, stars=True).highest_exact(10)


@query
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).autocomplete("10-0", 100)


@query
def khop_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbourhoods of all observed concepts."""
    g = _graph(spark, sf_dir)
    return g.exact_matches(counts.observed_terms(fx.rows(spark, sf_dir)).select(curie("prefix", "id").alias("curie")), 3)


@query
def component_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _graph(spark, sf_dir).component("mesh:10-0", 3)
    return nodes.select("curie", "name")


@query
def component_lookup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).component("mesh:10-0", 3)[1]


@query
def mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least mapping by id, with its evidence."""
    g = _graph(spark, sf_dir)
    one = g.first_mapping()
    return _number(g.mapping(one)).select("mapping", "subject", "subject_name", "predicate", "object", "object_name", "justification", "confidence", "mapping_set", "author")


@query
def mappings_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).mappings_of_set("set-O", 10).select("mapping", "subject", "predicate", "object").distinct()


@query
def example_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).example_mappings(5).select("mapping", "subject", "subject_name", "object", "object_name").distinct()


@query
def mapping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = counts.by_source(fx.rows(spark, sf_dir)).join(fx.mapping_sets(spark), "ms_id")
    return own.select(mapping_set_id("ms_id").alias("curie"), "title", "n")


@query
def mappings_by_justification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).mappings_by_justification("semapv:ManualMappingCuration")


@query
def mappings_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).mappings_by_author("orcid:3")


@query
def mappings_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).mappings_by_confidence(0.97)


# files and streams


@query
def sssom_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one table with a header, read back, and summed up by the rows' own confidence."""
    at = f"{Workspace(spark, 'sssom').path}/all.sssom.tsv"
    sssom.write_sssom(asm.deduplicate_evidence(fx.rows(spark, sf_dir)), at, set_id="https://example.org/all")
    back, _, _ = read_sssom(spark, at)
    return summed(back)


@query
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{Workspace(spark, 'jsonl').path}/all.jsonl"
    file_sinks.write_jsonl(asm.deduplicate_evidence(fx.rows(spark, sf_dir)), at)
    return summed(file_sources.read_jsonl(spark, at))


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in two batches of files, streamed into a store that keeps each evidence once."""
    at = Workspace(spark, "stream").path
    rows = fx.rows(spark, sf_dir)
    for k in range(2):
        rows.where(F.pmod(F.crc32("s_id"), F.lit(2)) == k).write.mode("append").parquet(f"{at}/in")
    ingest.ingest(ingest.stream_rows(spark, f"{at}/in"), f"{at}/store", f"{at}/progress").awaitTermination()
    return summed(ingest.stored(spark, f"{at}/store"))


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.select(F.unix_timestamp("start").alias("start"), "kind", "n")


@query
def messy_xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as cell lines have them, made from parts."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("COSMICID: "), k, F.lit("; RRID:CVCL_"), F.lpad(k, 4, "0"), F.lit(", LINCS_HMS:"), k, F.lit("); DSMZ:ACC"), k, F.lit("; omim:100050; what is this; CHEMBL:CHEMBL"), k)
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lpad(k, 7, "0").alias("id"), text.alias("value"))
    return tables.cell_line_xrefs(nodes).select(*TRIPLE, "confidence")


@query
def clinical_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three identifiers a line, some without a valid code, made from suppliers."""
    k = F.col("s_suppkey")
    lines = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(k.cast("string"), F.lit(".0")).alias("SNOMEDCT_ID"), F.when(k % 3 > 0, F.concat(F.lit("A"), F.lpad((k % 100).cast("string"), 2, "0"))).alias("ICD10CM_ID"), F.concat(F.lit("D"), k.cast("string")).alias("MESH_ID")
    )
    at = f"{Workspace(spark, 'triangles').path}/lines"
    lines.write.option("sep", "\t").option("header", "true").csv(at)
    return tables.clinical_triangles(spark, at, "snomedct").select(*TRIPLE, "justification")


@query
def prefix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.summarize_prefixes(fx.rows(spark, sf_dir)).select("prefix", "name")
