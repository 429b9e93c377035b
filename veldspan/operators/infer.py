"""Inference from single mappings: inversion, mutation, generalisation.

What is derived is one row for each source mapping, with the mapping's confidence as
it is at that time.  Rules are literal maps in expressions, so there is no join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspan.functions.confidence import derived, noisy_or
from veldspan.functions.refs import triple_id
from veldspan.operators.filters import mutation_applies
from veldspan.registry import REGISTRY
from veldspan.schema import DB_XREF, EXACT, FLIP, GENERALIZATIONS, INVERSION, KNOWLEDGE, ROW, TRIPLE


def with_confidence(rows: DataFrame) -> DataFrame:
    """``(triple, confidence)`` of each mapping."""
    return rows.groupBy(*TRIPLE).agg(noisy_or("confidence").alias("confidence"))


def derived_rows(source: DataFrame, *, predicate: Column, justification: str, factor: Column | float = 1.0, swap: bool = False) -> DataFrame:
    """A derived row of each line of ``source (triple, confidence)`` whose new predicate isn't null."""
    ends = {"s_prefix": "o_prefix", "s_id": "o_id", "o_prefix": "s_prefix", "o_id": "s_id"} if swap else {c: c for c in ("s_prefix", "s_id", "o_prefix", "o_id")}
    confidence = derived("confidence", factor)
    columns = {
        **{c: F.col(of) for c, of in ends.items()}, "p": predicate, "ev_type": F.lit("reasoned"), "justification": F.lit(justification),
        "author": F.lit(None).cast("string"), "row_confidence": confidence, "derived_from": F.array(triple_id()), "confidence": confidence,
        "ms_id": F.lit(None).cast("string"), "explanation": F.lit(None).cast("string"),
    }
    return source.where(predicate.isNotNull()).select(*(columns[c].alias(c) for c in ROW))


def _rule(table: Mapping[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("p"))


def flip(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The inverse of each mapping that has one; if ``strict``, others raise."""
    if strict and (bad := rows.where(_rule(FLIP).isNull()).select("p").limit(1).collect()):
        raise ValueError(f"no inverse of {bad[0].p}")
    return flipped(with_confidence(rows))


def flipped(mappings: DataFrame) -> DataFrame:
    """The same of ``mappings (triple, confidence)``."""
    return derived_rows(mappings, predicate=_rule(FLIP), justification=INVERSION, swap=True)


def with_inverses(mappings: DataFrame) -> DataFrame:
    """``mappings (triple, confidence)`` and their inverses, summed up where one is there already."""
    return with_confidence(mappings.unionByName(flipped(mappings).select(*mappings.columns)))


def reverse(rows: DataFrame) -> DataFrame:
    """The rows and the inverses of their mappings."""
    return rows.unionByName(flip(rows))


def generalize(rows: DataFrame) -> DataFrame:
    """The rows, and each strict predicate's loose one."""
    return rows.unionByName(derived_rows(with_confidence(rows), predicate=_rule(GENERALIZATIONS), justification=KNOWLEDGE))


def _pair_factors(pairs: Mapping[tuple[str, str], float] | Iterable[tuple[str, str]], confidence: float | None) -> dict[tuple[str, str], float]:
    given = dict(pairs) if isinstance(pairs, Mapping) else dict.fromkeys(pairs, 0.7 if confidence is None else confidence)
    return {(REGISTRY.normalize(s), REGISTRY.normalize(o)): float(f) for (s, o), f in given.items()}


def mutate(rows: DataFrame, pairs: Mapping[tuple[str, str], float] | Iterable[tuple[str, str]], old: str, new: str, confidence: float | None = None) -> DataFrame:
    """The rows, and for mappings by ``old`` between configured prefixes the same by ``new``."""
    factors = _pair_factors(pairs, confidence)
    if not factors:
        return rows
    table = F.create_map(*(F.lit(x) for (s, o), f in factors.items() for x in (f"{s}|{o}", f)))
    factor = F.try_element_at(table, F.concat_ws("|", "s_prefix", "o_prefix"))
    source = with_confidence(rows.where((F.col("p") == old) & factor.isNotNull()))
    return rows.unionByName(derived_rows(source, predicate=F.lit(new), justification=KNOWLEDGE, factor=factor))


def mutate_dbxrefs(rows: DataFrame, pairs: Mapping[tuple[str, str], float] | Iterable[tuple[str, str]], confidence: float | None = None) -> DataFrame:
    return mutate(rows, pairs, DB_XREF, EXACT, confidence)


def mutate_mutual_dbxrefs(rows: DataFrame, prefixes: Iterable[str], confidence: float | None = None) -> DataFrame:
    """Between any two different ones of the prefixes."""
    known = REGISTRY.normalize_all(prefixes)
    return mutate_dbxrefs(rows, [(a, b) for a in known for b in known if a != b], confidence)


@dataclass(frozen=True)
class Mutation:
    """Mappings of subject prefix ``source`` by ``old`` become mappings by ``new``."""

    source: str
    target: str | list[str] | None = None
    confidence: float = 1.0
    old: str = DB_XREF
    new: str = EXACT

    def __post_init__(self):
        object.__setattr__(self, "source", REGISTRY.normalize(self.source))
        if self.target is not None:
            known = REGISTRY.normalize_all(self.target)
            object.__setattr__(self, "target", known[0] if isinstance(self.target, str) else known)

    @property
    def applies(self) -> Column:
        return mutation_applies(self.source, self.target, self.old)


def replace_predicates(rows: DataFrame, mutations: Iterable[Mutation]) -> DataFrame:
    """Mappings to which a mutation applies are replaced by derived ones; at most one rule for each source prefix."""
    mutations = list(mutations)
    if len({m.source for m in mutations}) < len(mutations):
        raise KeyError("several mutations of one source prefix")
    if not mutations:
        return rows
    new = factor = None
    for m in mutations:
        new = F.when(m.applies, m.new) if new is None else new.when(m.applies, m.new)
        factor = F.when(m.applies, m.confidence) if factor is None else factor.when(m.applies, m.confidence)
    out = derived_rows(with_confidence(rows.where(new.isNotNull())), predicate=new, justification=KNOWLEDGE, factor=factor)
    return rows.where(new.isNull()).unionByName(out)
