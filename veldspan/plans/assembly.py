"""From raw rows to processed and prioritised mappings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from veldspan.operators import filters, infer
from veldspan.operators.assemble import assemble
from veldspan.operators.chains import chain_paths, chained_rows, infer_chains
from veldspan.workspace import Workspace


def process(
    rows: DataFrame, *, negatives: DataFrame | None = None, upgrade: Iterable[str] | None = None, mutations: Iterable[infer.Mutation] | None = None,
    remove: Iterable[str] | None = None, keep: Iterable[str] | None = None, post_remove: Iterable[str] | None = None, post_keep: Iterable[str] | None = None,
    subsets: DataFrame | None = None, remove_imprecise: bool = True, symmetric_negatives: bool = False,
) -> DataFrame:
    """Filter, assemble, mutate, reverse, chain, filter again: processed rows.

    ``subsets`` are hydrated members ``(prefix, id)``; ``negatives`` are triples.  Each evidence comes once.
    """
    if keep:
        rows = filters.keep_prefixes(rows, keep)
    if remove:
        rows = filters.drop_prefixes(rows, remove)
    if subsets is not None:
        rows = filters.keep_subsets(rows, subsets)
    if negatives is not None:
        rows = filters.drop_triples(rows, negatives, symmetric_negatives)
    rows = assemble(rows)
    if mutations:
        rows = infer.replace_predicates(rows, mutations)
    upgrade = list(upgrade or ())
    if len(upgrade) > 1:
        rows = infer.mutate_mutual_dbxrefs(rows, upgrade, 0.95)
    if remove_imprecise:
        rows = filters.drop_imprecise(rows)
    rows = (ws := Workspace(rows.sparkSession, "process")).save(rows, "rows")
    if rows.where("ev_type = 'reasoned'").isEmpty():  # nothing that is derived now can be there yet, so evidence isn't assembled again
        own = ws.save(infer.with_confidence(rows), "mappings")
        back = infer.flipped(own)
        edges = ws.save(infer.with_inverses(own), "edges")
        new = back.unionByName(chained_rows(chain_paths(edges, ws=ws, edges=edges)))
        if negatives is not None:  # the rows themselves have none
            new = filters.drop_triples(new, negatives, symmetric_negatives)
        rows = rows.unionByName(new)
    else:
        rows = assemble(infer_chains(infer.reverse(rows)))
        if negatives is not None:
            rows = filters.drop_triples(rows, negatives, symmetric_negatives)
    rows = filters.drop_self_matches(rows)
    if post_keep:
        rows = filters.keep_prefixes(rows, post_keep)
    if post_remove:
        rows = filters.drop_prefixes(rows, post_remove)
    return rows
