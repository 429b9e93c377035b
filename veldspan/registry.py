"""A small registry of prefixes: canonical forms, URI stems, identifier patterns, names.

Content is data, so a larger registry can be put in its place: ``Registry`` takes any
records.  Lookups become literal maps in expressions (a registry has hundreds of
records, not more) or a frame for joins.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prefix:
    prefix: str
    uri: str
    pattern: str | None = None
    name: str | None = None
    synonyms: tuple[str, ...] = ()
    homepage: str | None = None
    description: str | None = None
    license: str | None = None
    version: str | None = None
    deprecated: bool = False
    proprietary: bool = False
    has_terms: bool = True


_OBO = "http://purl.obolibrary.org/obo/"
# Public URI stems and identifier patterns.
DEFAULT = (
    Prefix("atcc", "https://www.atcc.org/products/", r"^[A-Za-z0-9-]+$", "American Type Culture Collection"),
    Prefix("bao", "http://www.bioassayontology.org/bao#BAO_", r"^\d{7}$", "BioAssay Ontology"),
    Prefix("bto", f"{_OBO}BTO_", r"^\d{7}$", "BRENDA Tissue Ontology"),
    Prefix("cas", "https://commonchemistry.cas.org/detail?cas_rn=", r"^\d{1,7}-\d{2}-\d$", "CAS Registry Number"),
    Prefix("cellosaurus", "https://www.cellosaurus.org/CVCL_", r"^[A-Z0-9]{4}$", "Cellosaurus", ("cvcl",)),
    Prefix("chebi", f"{_OBO}CHEBI_", r"^\d+$", "Chemical Entities of Biological Interest"),
    Prefix("chembl.cell", "https://www.ebi.ac.uk/chembl/cell_line_report_card/", r"^CHEMBL\d+$", "ChEMBL cell lines"),
    Prefix("chembl.compound", "https://www.ebi.ac.uk/chembl/compound/inspect/", r"^CHEMBL\d+$", "ChEMBL compounds"),
    Prefix("cl", f"{_OBO}CL_", r"^\d{7}$", "Cell Ontology"),
    Prefix("clo", f"{_OBO}CLO_", r"^\d{7}$", "Cell Line Ontology"),
    Prefix("cosmic.cell", "https://cancer.sanger.ac.uk/cell_lines/sample/overview?id=", r"^\d+$", "COSMIC cell lines"),
    Prefix("doid", f"{_OBO}DOID_", r"^\d+$", "Human Disease Ontology", ("do",)),
    Prefix("dsmz", "https://www.dsmz.de/collection/catalogue/details/culture/", r"^[A-Z]+[ -]?\d+$", "German collection of cell cultures"),
    Prefix("efo", "http://www.ebi.ac.uk/efo/EFO_", r"^\d{7}$", "Experimental Factor Ontology"),
    Prefix("ensembl", "https://www.ensembl.org/id/", r"^ENS[A-Z]*\d{11}$", "Ensembl"),
    Prefix("fplx", "https://identifiers.org/fplx:", r"^[A-Za-z0-9_]+$", "Protein families and complexes"),
    Prefix("go", f"{_OBO}GO_", r"^\d{7}$", "Gene Ontology"),
    Prefix("hgnc", "https://www.genenames.org/data/gene-symbol-report/#!/hgnc_id/HGNC:", r"^\d{1,5}$", "HUGO gene nomenclature"),
    Prefix("hms.lincs.cell", "http://lincs.hms.harvard.edu/db/cells/", r"^\d+(-\d+)?$", "LINCS cell lines"),
    Prefix("hp", f"{_OBO}HP_", r"^\d{7}$", "Human Phenotype Ontology", ("hpo",)),
    Prefix("iao", f"{_OBO}IAO_", r"^\d{7}$", "Information Artifact Ontology"),
    Prefix("icd10cm", "https://icd.codes/icd10cm/", r"^[A-Z]\d[0-9A-Z](\.[0-9A-Z]{1,4})?$", "ICD-10 clinical modification", ("icd",)),
    Prefix("jcrb", "https://cellbank.nibiohn.go.jp/~cellbank/en/search_res_det.cgi?RNO=", r"^JCRB[0-9.]+$", "Japanese cell bank"),
    Prefix("kegg.pathway", "https://www.kegg.jp/entry/", r"^[a-z]{2,4}\d{5}$", "KEGG pathways"),
    Prefix("mesh", "https://meshb.nlm.nih.gov/record/ui?ui=", r"^[A-Z]{1,2}\d+$", "Medical Subject Headings", ("msh",)),
    Prefix("mondo", f"{_OBO}MONDO_", r"^\d{7}$", "Mondo Disease Ontology"),
    Prefix("ncbigene", "https://www.ncbi.nlm.nih.gov/gene/", r"^\d+$", "NCBI Gene", ("entrez", "egid")),
    Prefix("ncit", f"{_OBO}NCIT_", r"^C\d+$", "NCI Thesaurus"),
    Prefix("obi", f"{_OBO}OBI_", r"^\d{7}$", "Ontology for Biomedical Investigations"),
    Prefix("oboinowl", "http://www.geneontology.org/formats/oboInOwl#"),
    Prefix("omim", "https://omim.org/entry/", r"^\d{6}$", "Online Mendelian Inheritance in Man", ("mim",)),
    Prefix("orcid", "https://orcid.org/", r"^\d{4}-\d{4}-\d{4}-\d{3}[0-9X]$", "Contributor identifiers"),
    Prefix("owl", "http://www.w3.org/2002/07/owl#"),
    Prefix("pubchem.compound", "https://pubchem.ncbi.nlm.nih.gov/compound/", r"^\d+$", "PubChem compounds"),
    Prefix("pw", f"{_OBO}PW_", r"^\d{7}$", "Pathway Ontology"),
    Prefix("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    Prefix("reactome", "https://reactome.org/content/detail/", r"^R-[A-Z]{3}-\d+$", "Reactome"),
    Prefix("semapv", "https://w3id.org/semapv/vocab/"),
    Prefix("skos", "http://www.w3.org/2004/02/skos/core#"),
    Prefix("snomedct", "http://snomed.info/id/", r"^\d+$", "SNOMED CT"),
    Prefix("umls", "https://uts.nlm.nih.gov/uts/umls/concept/", r"^C\d+$", "Unified Medical Language System"),
    Prefix("uniprot", "https://www.uniprot.org/uniprotkb/", r"^[A-Z0-9]{6,10}$", "UniProt"),
    Prefix("wikidata", "http://www.wikidata.org/entity/", r"^[PQ]\d+$", "Wikidata"),
    Prefix("wikipathways", "https://www.wikipathways.org/pathways/", r"^WP\d+$", "WikiPathways"),
)
# Vocabularies of the domain configurations, OBO ontologies first; the others expand by a resolver.
_MORE_OBO = {"caro": "CARO", "chmo": "CHMO", "fbbi": "FBbi", "fix": "FIX", "rex": "REX", "taxrank": "TAXRANK", "uberon": "UBERON"}
_MORE = (
    "ans.educationlevel",
    "ccle",
    "cgnc",
    "chembl.target",
    "civic.gid",
    "complexportal",
    "depmap",
    "flybase",
    "gard",
    "goldbook",
    "icd9",
    "icd9cm",
    "icd10",
    "icd11",
    "icdo",
    "intact",
    "isced1997",
    "isced2011",
    "isced2013",
    "kim.educationlevel",
    "medgen",
    "mgi",
    "oeh.educationlevel",
    "omim.ps",
    "openeduhub.context",
    "orpha",
    "panet",
    "rgd",
    "scomp",
    "sgd",
    "signor",
    "sty",
    "tdwg.taxonrank",
    "wormbase",
)
DEFAULT += tuple(Prefix(p, f"{_OBO}{stem}_", r"^[0-9]+$") for p, stem in _MORE_OBO.items())
DEFAULT += tuple(Prefix(p, f"https://identifiers.org/{p}:") for p in _MORE)


@dataclass(frozen=True)
class Registry:
    records: tuple[Prefix, ...] = field(default=DEFAULT)

    @cached_property
    def by_prefix(self) -> dict[str, Prefix]:
        return {r.prefix: r for r in self.records}

    @cached_property
    def canonical(self) -> dict[str, str]:
        """Lower-cased spelling to canonical prefix."""
        return {x.lower(): r.prefix for r in self.records for x in (r.prefix, *r.synonyms)}

    def normalize(self, prefix: str, strict: bool = True) -> str | None:
        """The canonical prefix; unknown ones raise, or give None if not strict."""
        out = self.canonical.get(prefix.strip().lower())
        if out is None and strict:
            raise ValueError(f"unknown prefix: {prefix!r}")
        return out

    def normalize_all(self, prefixes: str | Iterable[str]) -> list[str]:
        """Canonical prefixes in order, each once."""
        return list(dict.fromkeys(map(self.normalize, [prefixes] if isinstance(prefixes, str) else prefixes)))

    def problems(self, prefix: str) -> list[str]:
        """What is wrong with a prefix in a configuration."""
        known = self.normalize(prefix, strict=False)
        if known is None:
            return [f"{prefix}: unknown"]
        out = [f"{prefix}: not canonical, use {known}"] if known != prefix else []
        return out + ([f"{prefix}: deprecated"] if self.by_prefix[known].deprecated else [])

    def buildable(self) -> list[str]:
        """Prefixes whose terms can be loaded into the raw database."""
        return sorted(r.prefix for r in self.records if r.has_terms and r.pattern and not r.deprecated and not r.proprietary)

    def _lookup(self, table: dict[str, str], key: Column) -> Column:
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")

    def canonical_column(self, prefix: Column) -> Column:
        """The canonical prefix of a column, null where unknown."""
        return self._lookup(self.canonical, F.lower(F.trim(prefix)))

    def pattern_column(self, prefix: Column) -> Column:
        return self._lookup({r.prefix: r.pattern for r in self.records if r.pattern}, prefix)

    def uri_stem(self, prefix: Column) -> Column:
        return self._lookup({r.prefix: r.uri for r in self.records}, prefix)

    def frame(self, spark: SparkSession) -> DataFrame:
        """``prefix, name, homepage, description, license, version``."""
        rows = [(r.prefix, r.name, r.homepage, r.description, r.license, r.version) for r in self.records]
        return spark.createDataFrame(rows, "prefix string, name string, homepage string, description string, license string, version string")


REGISTRY = Registry()
