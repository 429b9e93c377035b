"""Named sources: functions of ``(spark, path)`` that give rows, with synonyms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldspan.sources import files, tables
from veldspan.sources.sssom import read_sssom

Source = Callable[..., DataFrame]


class Catalog:
    def __init__(self) -> None:
        self._by_name: dict[str, Source] = {}
        self._synonyms: dict[str, str] = {}

    @staticmethod
    def normalize(name: str) -> str:
        """``get_some_table_mappings`` and ``some-table`` are one name."""
        return name.lower().replace("-", "_").removeprefix("get_").removesuffix("_mappings").strip("_")

    def register(self, source: Source, name: str | None = None, *synonyms: str) -> Source:
        own = self.normalize(name or source.__name__)
        self._by_name[own] = source
        self._synonyms |= {self.normalize(s): own for s in synonyms}
        return source

    def get(self, name: str) -> Source:
        own = self.normalize(name)
        own = self._synonyms.get(own, own)
        if own not in self._by_name:
            raise KeyError(f"no source {name!r}; there are: {', '.join(self.names())}")
        return self._by_name[own]

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def load_all(self, spark: SparkSession, paths: dict[str, str]) -> DataFrame | None:
        """The union of the named sources."""
        out = None
        for name, path in paths.items():
            one = self.get(name)(spark, path)
            out = one if out is None else out.unionByName(one)
        return out


CATALOG = Catalog()
CATALOG.register(lambda spark, path, **how: read_sssom(spark, path, **how)[0], "sssom")
CATALOG.register(files.read_jsonl, "jsonl", "json lines")
CATALOG.register(files.read_parquet, "parquet")
CATALOG.register(files.read_xrefs, "ontology", "xrefs")
CATALOG.register(tables.lexical_table, "lexical table", "lexical")
CATALOG.register(tables.family_equivalences, "family equivalences", "fplx")
CATALOG.register(tables.gene_table, "gene table", "omim")
CATALOG.register(tables.clinical_pairs, "clinical pairs")
CATALOG.register(lambda spark, path, **how: tables.clinical_triangles(spark, path, "snomedct", **how), "clinical triangles via snomedct")
CATALOG.register(lambda spark, path, **how: tables.clinical_triangles(spark, path, "icd10cm", **how), "clinical triangles via icd10cm")
CATALOG.register(tables.pathway_equivalences, "pathway equivalences", "pathways")
for _kind in tables.THESAURUS:
    CATALOG.register(lambda spark, path, kind=_kind, **how: tables.thesaurus_pairs(spark, path, kind, **how), f"thesaurus {_kind}", f"ncit_{_kind}")
