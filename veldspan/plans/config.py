"""Declarative jobs: inputs, rules, outputs, and their cached levels.

A job has three levels, each derived from the one before: raw, processed, priority.
Refreshing a level refreshes those after it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspan import graph
from veldspan.operators import counts, filters
from veldspan.operators.hierarchy import hydrate_subsets
from veldspan.operators.infer import Mutation
from veldspan.operators.prioritize import prioritize
from veldspan.plans import landscape
from veldspan.plans.assembly import process
from veldspan.registry import REGISTRY
from veldspan.schema import MAPPING_SETS_SCHEMA
from veldspan.sinks.files import write_parquet, write_property_graph
from veldspan.sinks.sssom import write_sssom
from veldspan.sources.catalog import CATALOG, Catalog
from veldspan.sources.files import exists, read_first, read_parquet
from veldspan.workspace import Workspace, scratch, write_text


class Pack(NamedTuple):
    raw: DataFrame
    processed: DataFrame
    priority: DataFrame


Hook = Callable[["Configuration", Pack], None]


@dataclass
class Input:
    """A source by name, a path, and options for its reader."""

    source: str
    path: str
    options: dict = field(default_factory=dict)
    #: Keep only rows between priority prefixes already at the source; curated and lexical tables do so unless told otherwise.
    pre_filter: bool | None = None

    def load(self, spark: SparkSession, priority: list[str], catalog: Catalog = CATALOG) -> DataFrame:
        rows = catalog.get(self.source)(spark, self.path, **self.options)
        pre = catalog.normalize(self.source) in ("curated", "lexical", "lexical_table") if self.pre_filter is None else self.pre_filter
        return filters.keep_prefixes(rows, priority) if pre and priority else rows


@dataclass
class Configuration:
    name: str
    key: str
    inputs: list[Input]
    directory: str
    priority: list[str] = field(default_factory=list)
    negative_inputs: list[Input] = field(default_factory=list)
    mutations: list[Mutation] = field(default_factory=list)
    #: Prefix to CURIEs of hierarchy roots.
    subsets: dict[str, list[str]] = field(default_factory=dict)
    keep_prefixes: list[str] | None = None
    remove_prefixes: list[str] | None = None
    post_keep_prefixes: list[str] | None = None
    post_remove_prefixes: list[str] | None = None
    upgrade_prefixes: list[str] | None = None
    remove_imprecise: bool = True
    validate_raw: bool = False
    description: str | None = None
    creators: list[str] = field(default_factory=list)
    hooks: list[Hook] = field(default_factory=list)

    def __post_init__(self):
        self.priority = REGISTRY.normalize_all(self.priority or [i.path for i in self.inputs if REGISTRY.normalize(i.path, strict=False)])
        lists = (self.keep_prefixes, self.remove_prefixes, self.post_keep_prefixes, self.post_remove_prefixes, list(self.subsets))
        if problems := [p for x in lists for y in x or () for p in REGISTRY.problems(y)]:
            raise ValueError("; ".join(problems))

    @classmethod
    def from_prefixes(cls, name: str, prefixes: Iterable[str], paths: dict[str, str], directory: str, **more) -> Configuration:
        """One ontology table for each prefix, in order of priority."""
        prefixes = REGISTRY.normalize_all(prefixes)
        return cls(name, Catalog.normalize(name.replace(" ", "_")), [Input("ontology", paths[p]) for p in prefixes], directory, priority=prefixes, **more)

    def at(self, name: str) -> str:
        return f"{self.directory}/{name}"

    def set_metadata(self, level: str) -> dict:
        return {"id": f"https://example.org/mappings/{self.key}/{level}.sssom.tsv", "title": f"{self.name} ({level})", "sources": [i.path for i in self.inputs]}

    # levels

    def read(self, spark: SparkSession, level: str) -> DataFrame:
        """A level's first file that exists: Parquet, JSON lines, SSSOM."""
        names = ("parquet", "jsonl", "jsonl.gz", "sssom.tsv", "sssom.tsv.gz")
        return read_first(spark, *(self.at(f"{level}.{n}") for n in names))

    def load_raw(self, spark: SparkSession, catalog: Catalog = CATALOG) -> DataFrame:
        """The union of all inputs."""
        out = None
        for i in self.inputs:
            one = i.load(spark, self.priority, catalog)
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError(f"{self.name} has no inputs")
        return out

    def negatives(self, spark: SparkSession, catalog: Catalog = CATALOG) -> DataFrame | None:
        out = None
        for i in self.negative_inputs:
            one = catalog.get(i.source)(spark, i.path, **i.options)
            out = one if out is None else out.unionByName(one)
        return out

    def hydrated_subsets(self, spark: SparkSession, is_a: DataFrame | None) -> DataFrame | None:
        if not self.subsets:
            return None
        if is_a is None:
            raise ValueError("subsets need a hierarchy")
        roots = [(REGISTRY.normalize(p), *r.split(":", 1)) for p, refs in self.subsets.items() for r in refs]
        return hydrate_subsets(spark.createDataFrame(roots, "prefix string, ref_prefix string, ref_id string"), is_a)

    def assemble(
        self, spark: SparkSession, *, refresh: str | None = None, is_a: DataFrame | None = None, catalog: Catalog = CATALOG, write: bool = True, returning: str = "pack",
    ) -> Pack | DataFrame | None:
        """Raw, processed and priority rows; levels that exist are read unless ``refresh`` names them or one before.

        Levels are written as Parquet and read back, so none is computed twice, and
        their scratch tables go.  ``returning`` is ``pack``, a level's name, or ``none``.
        """
        if returning not in ("pack", *Pack._fields, "none"):
            raise ValueError(f"unknown return type: {returning}")
        levels = ("raw", "processed", "priority")
        if refresh not in (None, "source", *levels):
            raise ValueError(f"unknown level: {refresh}")
        first = len(levels) if refresh is None else max(0, ("source", *levels).index(refresh) - 1)
        out: dict[str, DataFrame] = {}

        def level(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            nonlocal first
            path = self.at(f"{name}.parquet")
            if levels.index(name) >= first or not exists(spark, path):
                first = min(first, levels.index(name))
                if not write:
                    out[name] = make()
                    return out[name]
                with scratch():
                    write_parquet(make(), path)
            out[name] = read_parquet(spark, path)
            return out[name]

        def raw() -> DataFrame:
            rows = self.load_raw(spark, catalog)
            return filters.validate(rows) if self.validate_raw else rows

        rows = level("raw", raw)
        if rows.isEmpty():
            raise ValueError(f"{self.name}: no raw mappings")
        processed = level("processed", lambda: process(
            rows, negatives=self.negatives(spark, catalog), upgrade=self.upgrade_prefixes, mutations=self.mutations, remove=self.remove_prefixes, keep=self.keep_prefixes,
            post_remove=self.post_remove_prefixes, post_keep=self.post_keep_prefixes, subsets=self.hydrated_subsets(spark, is_a), remove_imprecise=self.remove_imprecise,
        ))
        level("priority", lambda: prioritize(processed, self.priority))
        pack = Pack(**out)
        for hook in self.hooks:
            hook(self, pack)
        return {"pack": pack, "none": None}.get(returning, getattr(pack, returning, None))

    # outputs

    def write_exports(self, spark: SparkSession, pack: Pack, *, sets: DataFrame | None = None, labels: DataFrame | None = None, single_file: bool = False) -> None:
        """SSSOM of all levels, in parallel unless ``single_file``, and the property graph of the processed one."""
        with scratch():
            for name, rows in zip(Pack._fields, pack, strict=True):
                write_sssom(rows, self.at(f"{name}.sssom.tsv"), set_id=self.set_metadata(name)["id"], labels=labels, sets=sets, single_file=single_file)
            sets = spark.createDataFrame([], MAPPING_SETS_SCHEMA) if sets is None else sets
            one = graph.build(pack.processed, sets, priority_rows=pack.priority, names=labels, ws=Workspace(spark, "graph"))
            write_property_graph(one, self.at("graph"))

    def summarize(self, pack: Pack, terms: DataFrame, *, subset: DataFrame | None = None) -> dict:
        """Statistics of a finished job; ``terms (prefix, id)`` are full lists, ``subset (prefix, id)`` the hydrated members of limited ones.

        Overlaps count raw and processed mappings within the subsets.  The tables of
        counts, sources and the landscape, and the statistics, are written beside the levels.
        """
        began, spark = time.time(), pack.raw.sparkSession
        with scratch():
            raw, processed = (rows if subset is None else filters.keep_subsets(rows, subset) for rows in (pack.raw, pack.processed))
            observed = counts.observed_terms(pack.raw)
            over = landscape.overlaps(raw, processed, pack.priority, self.priority, terms, observed)
            land = landscape.analyze(processed, self.priority, terms, observed)
            sources = Workspace(spark, "summary").save(landscape.summary_frame(self.priority, terms, observed, subset), "sources")
            tables = {f"{name}_counts": counts.pivot(getattr(over, name), self.priority) for name in Pack._fields}
            tables |= {"source_summary": sources, "landscape": land.upset()}
            for name, df in tables.items():
                df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(self.at(name))
            out = land.summary().first().asDict() | landscape.source_summary(sources).first().asDict()
            out |= {"name": self.name, "distribution": {r.n_prefixes: r.n for r in land.distribution().collect()}, "seconds": round(time.time() - began, 3)}
            mappings = (df.select("s_prefix", "s_id", "p", "o_prefix", "o_id").distinct().count() for df in (raw, processed, pack.priority))
            out |= {f"{name}_mappings": n for name, n in zip(Pack._fields, mappings, strict=True)}
        write_text(spark, self.at("statistics.json"), json.dumps(out, indent=2, default=str))
        return out

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "hooks"}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Configuration:
        data = json.loads(text)
        data["inputs"] = [Input(**x) for x in data["inputs"]]
        data["negative_inputs"] = [Input(**x) for x in data.get("negative_inputs", ())]
        data["mutations"] = [Mutation(**x) for x in data.get("mutations", ())]
        return cls(**data)

    @classmethod
    def from_file(cls, path: str | Path) -> Configuration:
        return cls.from_json(Path(path).read_text())
