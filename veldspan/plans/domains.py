"""Ready configurations of eight domains: vocabularies by priority, roots of subsets, trust in cross-references.

Inputs are ontology tables of the vocabularies that are at hand; any others are added
by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from veldspan.operators.infer import Mutation
from veldspan.plans.config import Configuration, Hook, Input, Pack
from veldspan.sinks.files import write_parquet

# The domains.


@dataclass(frozen=True)
class Domain:
    name: str
    priority: tuple[str, ...]
    subsets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Confidence that a vocabulary's cross-references are exact.
    trust: dict[str, float] = field(default_factory=dict)
    #: Whether other prefixes go before or after inference, or stay.
    keep: str | None = None


_ICD = ("icd10cm", "icd10", "icd11", "icd9cm", "icd9", "icdo")
DOMAINS = {
    "anatomy": Domain(
        "Anatomy", ("uberon", "mesh", "bto", "caro", "ncit", "umls"),
        {
            "mesh": (
                "mesh:D001829",
                "mesh:D009141",
                "mesh:D004064",
                "mesh:D012137",
                "mesh:D014566",
                "mesh:D004703",
                "mesh:D002319",
                "mesh:D009420",
                "mesh:D012679",
                "mesh:D014024",
                "mesh:D005441",
                "mesh:D000825",
                "mesh:D013284",
                "mesh:D006424",
                "mesh:D004628",
                "mesh:D034582",
                "mesh:D018514",
                "mesh:D056229",
                "mesh:D056226",
                "mesh:D056224",
            ),
            "ncit": ("ncit:C12219",), "umls": ("sty:T024", "sty:T017"),
        },
        {"uberon": 0.8, "bto": 0.65, "caro": 0.8, "ncit": 0.7, "umls": 0.7}, "before",
    ),
    "cell": Domain(
        "Cell and cell line", ("mesh", "efo", "cellosaurus", "ccle", "depmap", "bto", "cl", "clo", "ncit", "umls"),
        {"mesh": ("mesh:D002477",), "efo": ("efo:0000324",), "ncit": ("ncit:C12508",), "umls": ("sty:T025",)},
        dict.fromkeys(("efo", "bto", "cl", "clo", "depmap", "ccle", "cellosaurus", "ncit", "umls"), 0.7), "before",
    ),
    "complex": Domain(
        "Protein complex", ("complexportal", "fplx", "go", "mesh", "chembl.target", "wikidata", "scomp", "signor", "intact"), {"go": ("go:0032991",)}, {"go": 0.95}, "after",
    ),
    "disease": Domain(
        "Disease", ("doid", "mondo", "efo", "mesh", "ncit", "orpha", "umls", "omim", "omim.ps", "gard", "medgen", *_ICD),
        {"mesh": ("mesh:D007239", "mesh:D001520", "mesh:D011579", "mesh:D001523", "mesh:D004191"), "efo": ("mondo:0000001",), "ncit": ("ncit:C2991",), "umls": ("sty:T049", "sty:T047", "sty:T191", "sty:T050", "sty:T048")},
        {"doid": 0.95, "mondo": 0.95, "efo": 0.9, "ncit": 0.7, "umls": 0.7, "orpha": 0.7}, "before",
    ),
    "education-level": Domain("Education level", ("isced1997", "isced2011", "isced2013", "kim.educationlevel", "oeh.educationlevel", "ans.educationlevel", "openeduhub.context")),
    "gene": Domain(
        "Gene", ("ncbigene", "hgnc", "mgi", "rgd", "cgnc", "wormbase", "flybase", "sgd", "omim", "civic.gid", "umls", "ncit", "wikidata"),
        {"umls": ("umls:C0017337",), "ncit": ("ncit:C16612",)}, {"umls": 0.8, "ncit": 0.8},
    ),
    "instrument": Domain("Instrument", ("chmo", "fbbi", "panet", "goldbook", "fix", "rex"), keep="after"),
    "taxrank": Domain("Taxonomical rank", ("taxrank", "tdwg.taxonrank", "ncit")),
}


def projection_hook(*pairs: tuple[str, str]) -> Hook:
    """After a job, write its one-to-one mappings between pairs of vocabularies, and those that aren't, beside it."""
    from veldspan.operators.many import project

    def hook(job: Configuration, pack: Pack) -> None:
        for source, target in pairs:
            good, bad = project(pack.processed, source, target)
            write_parquet(good, job.at(f"{source}_{target}.parquet"))
            write_parquet(bad, job.at(f"{source}_{target}_suspicious.parquet"))

    return hook


HOOKS: dict[str, tuple[Hook, ...]] = {"cell": (projection_hook(("ccle", "efo"), ("ccle", "depmap")),)}


def configure(key: str, paths: dict[str, str], directory: str, *, extra: tuple[Input, ...] = (), **more) -> Configuration:
    """The job of a domain over ontology tables ``paths`` by prefix."""
    d = DOMAINS[key]
    inputs = [*extra, *(Input("ontology", paths[p]) for p in d.priority if p in paths)]
    keep = {"before": {"keep_prefixes": list(d.priority)}, "after": {"post_keep_prefixes": list(d.priority)}}.get(d.keep, {})
    options = {
        "priority": list(d.priority), "subsets": {p: list(r) for p, r in d.subsets.items()}, "mutations": [Mutation(s, confidence=c) for s, c in d.trust.items()],
        "remove_imprecise": False, "hooks": list(HOOKS.get(key, ())),
    }
    return Configuration(f"{d.name} mappings", key, inputs, directory, **options | keep | more)
