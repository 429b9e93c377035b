"""Connected components by randomised contraction.

After Bögeholz, Brand, Todor: "In-database connected component analysis" (ICDE 2020).
In each round a node moves to that one of itself and its neighbours which comes first
in an order that is drawn anew, and links are carried over; those within one node go.
A round leaves at most about three quarters of the nodes that have links, and most
leave far fewer, so all rounds together cost little more than the first.  Whatever
the order, a node moves within its component: results don't depend on it.

A round is a grouped minimum, with partial results before the shuffle, and two joins
of links with one line a node, so a hub's links are never gathered as one list: its
side of the join is split by adaptive execution.  Rounds are written to the shared
folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veldspan.workspace import Workspace

#: Plans of these alone are read again rather than stored.
_PLAIN = {"Project", "Filter", "Relation", "SubqueryAlias"}


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for all nodes on ``edges``; component = smallest node.

    Self-loops keep their node.  Null ends are dropped.  No edges: no rows.
    Rounds run on longs: other nodes are numbered first, and components named at the end.
    """
    ws = Workspace(edges.sparkSession, "components")
    parts = ws.save(_parts(edges, a, b, ws, max_rounds), "parts")
    least = parts.groupBy("component").agg(F.min("node").alias("least"))
    return parts.join(least, "component").select("node", F.col("least").alias("component"))


def component_numbers(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """The same, but components are told apart by some long each, which spares their names."""
    return _parts(edges, a, b, Workspace(edges.sparkSession, "components"), max_rounds)


def _parts(edges: DataFrame, a: str, b: str, ws: Workspace, max_rounds: int) -> DataFrame:
    start = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    if not is_plain(start):
        start = ws.save(start.distinct(), "given")
    longs = all(isinstance(start.schema[c].dataType, LongType) for c in ("u", "v"))
    if longs:
        nodes, links = _moved(_both_ways(start, F.col("u"), F.col("v")), F.col("node"), ws, "nodes", 0), start
    else:
        nodes, links = _numbered(start, ws)
    root = _contracted(links, nodes.select("number", "to"), ws, max_rounds)
    out = nodes if root is None else nodes.join(root, "to", "left").withColumn("to", F.coalesce("root", "to"))
    return out.select("node", F.col("to").alias("component"))


def is_plain(df: DataFrame) -> bool:
    """Whether a frame is a scan of files with filters and expressions: cheaper to read again than to store."""
    names = {m.group(1) if (m := re.match(r"[\s:+|-]*([A-Za-z]+)", line)) else "" for line in df._jdf.queryExecution().analyzed().toString().splitlines()}
    return names <= _PLAIN


def _order(x: str, k: int) -> Column:
    """The order of round ``k``."""
    return F.xxhash64(F.col(x), F.lit(k))


def _both_ways(start: DataFrame, u: Column, v: Column) -> DataFrame:
    """``(node, other)`` of both ends of each edge, ``other`` by its number."""
    ends = (F.struct(F.col(c).alias("node"), x.alias("other")) for c, x in (("u", v), ("v", u)))
    return start.select(F.inline(F.array(*ends)))


def _moved(ends: DataFrame, number: Column, ws: Workspace, name: str, k: int | None = None) -> DataFrame:
    """``(node, number, to)``: each node and which of itself and its neighbours it moves to; without ``k`` the least number."""
    first = F.min("other") if k is None else F.min_by("other", _order("other", k))
    own = ends.groupBy("node").agg(first.alias("first")).select("node", number.alias("number"), "first")
    comes_first = F.col("first") < F.col("number") if k is None else _order("first", k) < _order("number", k)
    return ws.save(own.select("node", "number", F.when(comes_first, F.col("first")).otherwise(F.col("number")).alias("to")), name)


def _numbered(start: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Nodes with their numbers as ``_moved`` gives them, and the edges between numbers.

    Hashes serve as numbers while no two nodes share one, which spares the edges two
    joins; otherwise nodes are numbered by their places in a written table.
    """
    u, v = F.xxhash64("u"), F.xxhash64("v")
    nodes = _moved(_both_ways(start, u, v), F.xxhash64("node"), ws, "nodes")  # hashes are in random order already
    n, distinct = nodes.agg(F.count("*"), F.count_distinct("number")).first()
    if n == distinct:
        return nodes, start.select(u.alias("u"), v.alias("v"))
    placed = ws.save(nodes.select("node", F.monotonically_increasing_id().alias("number")), "places")
    by_u, by_v = (placed.select(F.col("node").alias(c), F.col("number").alias(f"{c}_number")) for c in ("u", "v"))
    links = ws.save(start.join(by_u, "u").join(by_v, "v").select(F.col("u_number").alias("u"), F.col("v_number").alias("v")), "placed")
    moved = _moved(_both_ways(links, F.col("u"), F.col("v")), F.col("node"), ws, "moved", 0)
    return placed.join(moved.select("number", "to"), "number"), links


def _contracted(links: DataFrame, nodes: DataFrame, ws: Workspace, max_rounds: int) -> DataFrame | None:
    """``(to, root)``: where those that nodes have moved to end, as far as they move on; None if none does."""
    levels: list[DataFrame] = []
    for k in range(max_rounds):
        links = ws.save(_carried(links, nodes), f"links{k}")
        if k:
            ws.drop(f"links{k - 1}")
        if links.isEmpty():
            break
        nodes = _moved(_both_ways(links, F.col("u"), F.col("v")), F.col("node"), ws, f"level{k}", k + 1).select("number", "to")
        levels.append(nodes)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = None
    for k, level in reversed(list(enumerate(levels))):
        own = level.select("number", F.col("to").alias("via"))
        if root is not None:
            own = own.join(root.withColumnRenamed("to", "via"), "via", "left").select("number", F.coalesce("root", "via").alias("via"))
        root = ws.save(own.select(F.col("number").alias("to"), F.col("via").alias("root")), f"roots{k}")
    return root


def _carried(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between what their ends have moved to, each once, without those within one."""
    for end in ("u", "v"):
        links = links.join(nodes.select(F.col("number").alias(end), F.col("to").alias(f"{end}_to")), end)
    out = links.where("u_to <> v_to").select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v"))
    return out.distinct()
