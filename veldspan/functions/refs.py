"""CURIEs, URIs and identity hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspan.registry import REGISTRY, Registry
from veldspan.schema import IDENTITY, TRIPLE


def curie(prefix: str | Column, identifier: str | Column) -> Column:
    """``prefix:identifier``; null if either is."""
    return F.concat(_c(prefix), F.lit(":"), _c(identifier))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prefix_of(curie_: str | Column) -> Column:
    """What stands before the first colon; null if there is none."""
    return F.nullif(F.regexp_extract(_c(curie_), r"^([^:]+):.+$", 1), F.lit(""))


def identifier_of(curie_: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(curie_), r"(?s)^[^:]+:(.+)$", 1), F.lit(""))


def normalized_curie(curie_: str | Column, registry: Registry = REGISTRY) -> Column:
    """The CURIE with a canonical prefix; null where the prefix is unknown or none."""
    return curie(registry.canonical_column(prefix_of(curie_)), identifier_of(curie_))


def uri(prefix: str | Column, identifier: str | Column, registry: Registry = REGISTRY) -> Column:
    """The expanded reference; null where the prefix has no stem."""
    return F.concat(registry.uri_stem(_c(prefix)), _c(identifier))


def uri_of(curie_: str | Column, registry: Registry = REGISTRY) -> Column:
    return uri(prefix_of(curie_), identifier_of(curie_), registry)


def reference_of(uri_: str | Column, registry: Registry = REGISTRY) -> Column:
    """The CURIE of a URI, by the longest stem that it starts with; null if none."""
    by_length = sorted(registry.records, key=lambda r: -len(r.uri))
    found = [F.when(F.startswith(_c(uri_), F.lit(r.uri)), F.concat(F.lit(f"{r.prefix}:"), F.substring(_c(uri_), len(r.uri) + 1, 1 << 30))) for r in by_length]
    return F.coalesce(*found)


def triple_id(registry: Registry = REGISTRY) -> Column:
    """``mapping:`` and the SHA-256 of the three URIs joined by blanks; null where one can't be expanded."""
    return hashed(uri("s_prefix", "s_id", registry), uri_of("p", registry), uri("o_prefix", "o_id", registry))


def triple_id_of(subject: Column, predicate: Column, obj: Column, registry: Registry = REGISTRY) -> Column:
    """The same of three CURIEs."""
    return hashed(uri_of(subject, registry), uri_of(predicate, registry), uri_of(obj, registry))


def hashed(s: Column, p: Column, o: Column) -> Column:
    """The same of three URIs."""
    return F.concat(F.lit("mapping:"), F.sha2(F.concat(s, F.lit(" "), p, F.lit(" "), o), 256))


def evidence_id() -> Column:
    """16 hex digits of a row's identity: the same row of two mapping sets has one id."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [*TRIPLE, *IDENTITY]]
    return F.concat(F.lit("sssom.record:"), F.lpad(F.hex(F.xxhash64(F.concat_ws("\x01", *parts))), 16, "0"))


def mapping_set_id(uri_: str | Column) -> Column:
    return F.concat(F.lit("mappingset:"), F.md5(_c(uri_)))
