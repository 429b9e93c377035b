"""Star graphs: each concept mapped to its component's preferred one, and their use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspan.functions.refs import curie, normalized_curie
from veldspan.operators.components import components
from veldspan.registry import REGISTRY
from veldspan.schema import EXACT, OBJECT, ROW, SUBJECT
from veldspan.workspace import Workspace


def _position(priority: list[str], column: str) -> F.Column:
    """0, 1, ... by priority; null for prefixes that have none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col(column)), F.lit(0)) - 1


def preferred(parts: DataFrame, priority: list[str]) -> DataFrame:
    """``(component, prefix, id)``: the reference whose prefix comes first; of several the least identifier."""
    at = _position(priority, "prefix")
    best = F.min(F.struct(at.alias("at"), "id", "prefix")).alias("b")
    return parts.where(at.isNotNull()).groupBy("component").agg(best).select("component", "b.prefix", "b.id")


def star_edges(exact: DataFrame, priority: Iterable[str]) -> DataFrame:
    """``(s_prefix, s_id, o_prefix, o_id)``: each concept of the exact mappings and its component's preferred one."""
    parts = Workspace(exact.sparkSession, "stars").save(components(exact, named=False), "parts")
    hubs = preferred(parts, [REGISTRY.normalize(p) for p in priority]).select("component", F.col("prefix").alias("o_prefix"), F.col("id").alias("o_id"))
    stars = parts.join(hubs, "component").select(F.col("prefix").alias("s_prefix"), F.col("id").alias("s_id"), *OBJECT)
    return stars.where((F.col("s_prefix") != F.col("o_prefix")) | (F.col("s_id") != F.col("o_id")))


def in_stars(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """The rows along ``star_edges``."""
    pair = [*SUBJECT, *OBJECT]
    own, stars = (df.withColumn("_hash", F.xxhash64(*pair)) for df in (rows, stars))  # decides nearly all comparisons of a sort
    return own.join(stars, ["_hash", *pair], "left_semi").select(*rows.columns)


def prioritize(rows: DataFrame, priority: Iterable[str]) -> DataFrame:
    """Existing exact rows from each concept to its component's preferred one.

    Concepts without such a row are left out.  Sorting is left to ``in_order``.
    """
    exact = rows.where(F.col("p") == EXACT)
    return in_stars(exact, star_edges(exact, priority)).select(*ROW)


def in_order(rows: DataFrame, priority: Iterable[str]) -> DataFrame:
    """By the object's priority and identifier, then by the subject."""
    return rows.orderBy(_position([REGISTRY.normalize(p) for p in priority], "o_prefix"), "o_id", *SUBJECT)


def repeated_subjects(rows: DataFrame) -> DataFrame:
    """``(s_prefix, s_id, n)`` of subjects with several objects."""
    return rows.select(*SUBJECT, *OBJECT).distinct().groupBy(*SUBJECT).agg(F.count("*").alias("n")).where("n > 1")


def check_projection(rows: DataFrame) -> DataFrame:
    """``rows`` if each subject has one object; raises with the worst 20 otherwise."""
    if bad := repeated_subjects(rows).orderBy(F.desc("n"), *SUBJECT).limit(20).collect():
        raise ValueError("not a projection: " + ", ".join(f"{r.s_prefix}:{r.s_id} ({r.n})" for r in bad))
    return rows


def remapping(rows: DataFrame) -> DataFrame:
    """``(s_curie, o_curie)``, one line for each subject."""
    return rows.select(curie("s_prefix", "s_id").alias("s_curie"), curie("o_prefix", "o_id").alias("o_curie")).distinct()


def prioritize_column(rows: DataFrame, df: DataFrame, *, column: str, target: str | None = None) -> DataFrame:
    """``df`` with ``target``: the preferred CURIE, else the normalised one, else the text as it is."""
    to = remapping(check_projection(rows)).select(F.col("s_curie").alias("__from"), F.col("o_curie").alias("__to"))
    norm = normalized_curie(df[column])
    own = df.withColumn("__norm", norm)
    out = own.join(to, F.col("__norm") == F.col("__from"), "left")
    return out.withColumn(target or f"{column}_prioritized", F.coalesce("__to", "__norm", F.col(column))).drop("__from", "__to", "__norm")


def update_literals(literals: DataFrame, rows: DataFrame) -> DataFrame:
    """``literals (prefix, id, ...)`` with each reference replaced by the preferred one."""
    to = check_projection(rows).select(F.col("s_prefix").alias("prefix"), F.col("s_id").alias("id"), *OBJECT).distinct()
    out = literals.join(to, ["prefix", "id"], "left")
    kept = [c for c in literals.columns if c not in ("prefix", "id")]
    return out.select(F.coalesce("o_prefix", "prefix").alias("prefix"), F.coalesce("o_id", "id").alias("id"), *kept)


def followed(to: DataFrame, most_rounds: int = 20) -> DataFrame:
    """``(prefix, id, o_prefix, o_id)`` whose objects have been followed to where they lead in the end.

    Each round doubles the steps that are followed; star graphs need none.  Cycles raise.
    """
    ws, own = Workspace(to.sparkSession, "followed"), ["prefix", "id"]
    to = ws.save(to, "step0")
    for k in range(1, most_rounds + 1):
        further = to.select(F.col("prefix").alias("o_prefix"), F.col("id").alias("o_id"), F.col("o_prefix").alias("n_prefix"), F.col("o_id").alias("n_id"))
        if to.join(further, OBJECT, "left_semi").isEmpty():
            return to
        moved = to.join(further, OBJECT, "left").select(*own, F.coalesce("n_prefix", "o_prefix").alias("o_prefix"), F.coalesce("n_id", "o_id").alias("o_id"))
        to = ws.save(moved, f"step{k}")
    raise ValueError("remapping doesn't end: it has a cycle")


def standardize_terms(terms: DataFrame) -> DataFrame:
    """Lexical terms with canonical ``db`` and ``source_db``; unknown ones stay."""
    return terms.withColumns({c: F.coalesce(REGISTRY.canonical_column(F.col(c)), F.col(c)) for c in ("db", "source_db")})


def reprioritize_terms(terms: DataFrame, rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Lexical terms moved onto the preferred reference, where they came from kept, repeats removed.

    ``terms (text, norm_text, db, id, entry_name, status, source, organism, source_db, source_id)``.
    ``names (prefix, id, name)`` gives moved terms their entry's name.  Rows that
    lead from one reference to the next are followed to the last.
    """
    to = followed(check_projection(rows).select(F.col("s_prefix").alias("prefix"), F.col("s_id").alias("id"), *OBJECT).distinct())
    out = terms.join(to.withColumnRenamed("prefix", "db"), ["db", "id"], "left")
    if names is None:
        out = out.withColumn("new_name", F.lit(None).cast("string"))
    else:
        out = out.join(names.select(F.col("prefix").alias("o_prefix"), F.col("id").alias("o_id"), F.col("name").alias("new_name")), OBJECT, "left")
    moved = F.col("o_prefix").isNotNull()
    out = out.select(
        "text", "norm_text", F.coalesce("o_prefix", "db").alias("db"), F.coalesce("o_id", "id").alias("id"), F.coalesce("new_name", "entry_name").alias("entry_name"),
        "status", "source", "organism", F.when(moved, F.coalesce("source_db", "db")).otherwise(F.col("source_db")).alias("source_db"),
        F.when(moved, F.coalesce("source_id", "id")).otherwise(F.col("source_id")).alias("source_id"),
    )
    # of the terms of one text and reference, the best kind stays: names before synonyms, curated before the rest
    rank = F.when(F.col("status") == "name", 0).when(F.col("status") == "curated", 1).when(F.col("status") == "synonym", 2).otherwise(3)
    rest = [c for c in out.columns if c not in ("text", "norm_text", "db", "id")]
    best = out.groupBy("text", "norm_text", "db", "id").agg(F.min(F.struct(rank.alias("rank"), *(F.coalesce(c, F.lit("")).alias(f"k_{c}") for c in rest), *rest)).alias("b"))
    return best.select("text", "norm_text", "db", "id", *(F.col(f"b.{c}").alias(c) for c in rest)).select(*out.columns)


def equivalence_classes(processed: DataFrame, priority_rows: DataFrame) -> DataFrame:
    """``(prefix, id, priority)`` of each concept: whether it is the preferred one of a component."""
    ends = processed.select(F.explode(F.array(F.struct(F.col("s_prefix").alias("prefix"), F.col("s_id").alias("id")), F.struct(F.col("o_prefix").alias("prefix"), F.col("o_id").alias("id")))).alias("r"))
    concepts = ends.select("r.*").distinct()
    hubs = priority_rows.select(F.col("o_prefix").alias("prefix"), F.col("o_id").alias("id"), F.lit(True).alias("priority")).distinct()
    return concepts.join(hubs, ["prefix", "id"], "left").fillna({"priority": False})
