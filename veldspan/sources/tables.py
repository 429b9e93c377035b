"""Per-format parsers: tables of named columns in, rows out.

Each takes a path (a file or a folder of files) and reads it with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan.functions.formats import strip_prefix
from veldspan.functions.refs import identifier_of, prefix_of
from veldspan.registry import REGISTRY
from veldspan.schema import CHAIN, DB_XREF, EXACT, LEXICAL, MANUAL, UNSPECIFIED
from veldspan.sources.rows import to_rows


def _csv(spark: SparkSession, path: str, columns: str, *, sep: str = "\t", header: bool = False) -> DataFrame:
    """Columns by position, all text; with a header they are picked by name."""
    names = columns.split()
    reader = spark.read.option("sep", sep).option("header", str(header).lower())
    if header:
        return reader.option("inferSchema", "false").csv(path).select(*names)
    return reader.schema(", ".join(f"`{n}` string" for n in names)).csv(path)


def curated(rows: DataFrame, source: str) -> DataFrame:
    """Rows whose set is overwritten, as for curated positive, negative and predicted tables."""
    return rows.withColumn("ms_id", F.lit(source))


def lexical_table(spark: SparkSession, path: str, *, confidence: float = 0.95) -> DataFrame:
    """Headerless: prefix, id, (name), prefix, id, ...; rows of unknown prefixes go."""
    df = _csv(spark, path, "sp si sn tp ti")
    return to_rows(df, (F.col("sp"), F.col("si")), (F.col("tp"), F.col("ti")), predicate=EXACT, justification=LEXICAL, confidence=confidence, ms_id=path, validate=False)


def family_equivalences(spark: SparkSession, path: str, *, confidence: float = 0.99, author: str | None = None) -> DataFrame:
    """Headerless CSV: target prefix, target id, family.  Text-mining names and one vocabulary's families of families go."""
    df = _csv(spark, path, "tp ti si", sep=",")
    df = df.where(~F.col("tp").isin("MEDSCAN", "BEL") & ~((F.col("tp") == "NXP") & F.startswith("ti", F.lit("FA:"))))
    return to_rows(df, ("fplx", F.col("si")), (F.col("tp"), F.col("ti")), justification=MANUAL, confidence=confidence, author=author, ms_id=path)


#: Of each thesaurus table: columns, whether they have a header, object prefix, literal prefix of its identifiers.
THESAURUS = {
    "hgnc": ("ncit hgnc", False, "hgnc", "HGNC:"),
    "go": ("go ncit", False, "go", "GO:"),
    "chebi": ("ncit chebi", False, "chebi", "CHEBI:"),
    "uniprot": ("ncit uniprot", True, "uniprot", ""),
}


def thesaurus_pairs(spark: SparkSession, path: str, kind: str, *, confidence: float = 0.99) -> DataFrame:
    """Mappings from thesaurus codes to one other vocabulary; the ``go`` table's columns are the other way round."""
    columns, header, target, literal = THESAURUS[kind]
    if header:
        df = spark.read.option("sep", "\t").option("header", "true").csv(path)
        df = df.toDF(*columns.split(), *df.columns[2:])
    else:
        df = _csv(spark, path, columns)
    other = strip_prefix(target, literal) if literal else F.col(target)
    return to_rows(df, ("ncit", F.col("ncit")), (target, other), confidence=confidence, ms_id=path)


def gene_table(spark: SparkSession, path: str, *, confidence: float = 0.99) -> DataFrame:
    """Comment lines, then identifier, type, gene id, symbol, Ensembl id: up to two mappings a line."""
    df = _csv(spark, path, "id type entrez symbol ensembl").where(~F.startswith("id", F.lit("#")))
    pairs = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(p).alias("p"), F.col(c).alias("i"))) for p, c in (("ncbigene", "entrez"), ("ensembl", "ensembl")))))
    df = df.select("id", F.explode(pairs).alias("x"))
    return to_rows(df, ("omim", F.col("id")), (F.col("x.p"), F.col("x.i")), confidence=confidence, ms_id=path)


def compound_names(spark: SparkSession, path: str, headings: DataFrame, *, confidence: float = 0.99) -> DataFrame:
    """Compound and heading name a line; ``headings (name, id)`` resolves names, and names that it lacks go."""
    df = _csv(spark, path, "cid name").join(headings.select("name", "id").distinct(), "name")
    return to_rows(df, ("pubchem.compound", F.col("cid")), ("mesh", F.col("id")), confidence=confidence, ms_id=path)


# Prefixes of the clinical tables' resources.
_CLINICAL = {"MESH": "mesh", "ICD10CM": "icd10cm", "SNOMEDCT_US_2016_03_01": "snomedct"}


def clinical_pairs(spark: SparkSession, path: str, *, confidence: float = 0.8) -> DataFrame:
    """Disease ontology ids with ``resource`` and ``resource_ID``; chained by those who made the table."""
    df = _csv(spark, path, "DO_ID resource resource_ID", header=True)
    table = F.create_map(*(F.lit(x) for kv in _CLINICAL.items() for x in kv))
    return to_rows(df, ("doid", strip_prefix("DO_ID", "DOID:")), (F.try_element_at(table, F.col("resource")), F.col("resource_ID")), justification=CHAIN, confidence=confidence, ms_id=path)


def clinical_triangles(spark: SparkSession, path: str, via: str, *, confidence: float = 0.8) -> DataFrame:
    """Three identifiers a line, ``via`` one of them (``snomedct`` or ``icd10cm``): its pairs are given, the third is chained.

    Without a valid ICD code only the MeSH and SNOMED CT pair is left.
    """
    df = _csv(spark, path, "SNOMEDCT_ID ICD10CM_ID MESH_ID", header=True)
    ids = {"mesh": F.col("MESH_ID"), "snomedct": F.col("SNOMEDCT_ID").try_cast("double").cast("long").cast("string"), "icd10cm": F.col("ICD10CM_ID")}
    pairs = (("mesh", "snomedct"), ("mesh", "icd10cm"), ("icd10cm", "snomedct"))
    each = [F.struct(F.lit(a).alias("a"), ids[a].alias("x"), F.lit(b).alias("b"), ids[b].alias("y"), F.lit(UNSPECIFIED if via in (a, b) else CHAIN).alias("j")) for a, b in pairs]
    df = df.select(F.explode(F.array(*each)).alias("t")).select("t.*")
    bad_subject = (F.col("a") == "icd10cm") & ~F.rlike("x", REGISTRY.pattern_column(F.col("a")))
    return to_rows(df.where(~F.coalesce(bad_subject, F.lit(True))), (F.col("a"), F.col("x")), (F.col("b"), F.col("y")), justification=F.col("j"), confidence=confidence, ms_id=path)


def pathway_equivalences(spark: SparkSession, path: str, *, confidence: float = 0.99) -> DataFrame:
    """CSV files of one folder: equivalent pathways, ``path:`` taken off identifiers."""
    df = spark.read.option("header", "true").csv(path).where(F.col("Mapping Type") == "equivalentTo")
    prefix = lambda c: F.when(F.lower(c) == "kegg", "kegg.pathway").otherwise(F.lower(F.col(c)))
    own = lambda c: strip_prefix(c, "path:")
    return to_rows(df, (prefix("Source Resource"), own("Source ID")), (prefix("Target Resource"), own("Target ID")), justification=MANUAL, confidence=confidence, ms_id=path)


# What messy cell-line references start with, in the order of trial: target prefix, and what is put before the rest.
XREF_RULES = (
    ("Sanger:COSMICID:", "cosmic.cell", ""), ("atcc:COSMICID:", "cosmic.cell", ""), ("DSMZ:COSMICID:", "cosmic.cell", ""),
    ("COSMIC:COSMICID:", "cosmic.cell", ""), ("RIKEN:COSMICID:", "cosmic.cell", ""), ("COSMICID:", "cosmic.cell", ""), ("LINCS_HMS:", "hms.lincs.cell", ""),
    ("HMSL:HMSL", "hms.lincs.cell", ""), ("CHEMBL:", "chembl.cell", ""), ("ChEMBL:", "chembl.cell", ""), ("BTO_", "bto", ""), ("CVCL_", "cellosaurus", ""),
    ("JHSF:", "jcrb", ""), ("CRL-", "atcc", "CRL-"), ("jcrb:JHSF:", "jcrb", ""), ("JCRB", "jcrb", "JCRB"), ("ATCCCRL", "atcc", "CRL"), ("bto:BAO_", "bao", ""),
    ("ACC", "dsmz", "ACC"), ("DSMZACC", "dsmz", "ACC"), ("dsmz:ACC", "dsmz", "ACC-"), ("DSMZ:ACC", "dsmz", "ACC-"),
)
SKIPPED_XREFS = ("omim",)


def parse_xref(text: Column) -> Column:
    """``(prefix, id)`` of one messy reference without blanks; null parts where nothing fits."""
    text = F.regexp_replace(text, "^(rrid:)?(RRID:)?", "")
    parsed = None
    for start, prefix, before in XREF_RULES:
        value = F.struct(F.lit(prefix).alias("prefix"), F.concat(F.lit(before), F.substring(text, len(start) + 1, 1 << 30)).alias("id"))
        hit = F.startswith(text, F.lit(start))
        parsed = F.when(hit, value) if parsed is None else parsed.when(hit, value)
    plain = F.struct(REGISTRY.canonical_column(prefix_of(text)).alias("prefix"), identifier_of(text).alias("id"))
    return parsed.otherwise(plain)


def split_xrefs(text: Column) -> Column:
    """Parts between ``;`` and ``,``, without blanks and closing brackets at the end."""
    return F.transform(F.split(text, "[;,]"), lambda p: F.regexp_replace(F.replace(p, F.lit(" "), F.lit("")), r"\)+$", ""))


def cell_line_xrefs(nodes: DataFrame, *, confidence: float = 0.8, ms_id: str = "cell line references") -> DataFrame:
    """``nodes (id, value)``: free-text see-also values of cell lines."""
    each = nodes.select("id", F.explode(split_xrefs(F.col("value"))).alias("x")).where("x <> ''").select("id", parse_xref(F.col("x")).alias("r"))
    each = each.where(~F.col("r.prefix").isin(*SKIPPED_XREFS))
    return to_rows(each, ("clo", F.col("id")), (F.col("r.prefix"), F.col("r.id")), predicate=DB_XREF, confidence=confidence, ms_id=ms_id)


# Properties that aren't vocabularies of concepts.
SKIPPED_PROPERTIES = ("doi", "inchi", "orcid", "pmc", "pubmed", "smiles")


def property_values(spark: SparkSession, path: str, prefix: str, *, predicate: str = EXACT, confidence: float = 0.99) -> DataFrame:
    """JSON records ``wikidata_id, id`` of one property; only items, and identifiers without a literal prefix."""
    df = spark.read.schema("wikidata_id string, id string").option("multiLine", "true").json(path).where(F.startswith("wikidata_id", F.lit("Q")))
    own = F.regexp_replace("id", f"(?i)^{prefix}_", "")
    return to_rows(df, ("wikidata", F.col("wikidata_id")), (prefix, own), predicate=predicate, confidence=confidence, ms_id=path)


def all_property_values(spark: SparkSession, paths: dict[str, str], **how) -> DataFrame | None:
    """The union over properties, those that aren't vocabularies left out."""
    out = None
    for prefix, path in sorted(paths.items()):
        if prefix not in SKIPPED_PROPERTIES:
            one = property_values(spark, path, prefix, **how)
            out = one if out is None else out.unionByName(one)
    return out
