"""DuckDB SQL for the registered queries; pieces are CTEs that build on each other."""

from __future__ import annotations

_PIECES: dict[str, str] = {
    # the derived evidence rows
    "f": """SELECT ['doid','mesh','umls','efo'][1 + l_linenumber % 4] AS s_prefix,
 concat(CAST(l_orderkey // 4 AS VARCHAR), '-', CAST(l_suppkey % 2 AS VARCHAR)) AS s_id,
 CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'skos:exactMatch' WHEN 'RF' THEN 'skos:exactMatch' WHEN 'NO' THEN 'oboinowl:hasDbXref' WHEN 'AO' THEN 'skos:broadMatch' WHEN 'NF' THEN 'skos:narrowMatch' ELSE 'skos:closeMatch' END AS p,
 ['doid','mesh','umls','efo','ncit'][1 + l_partkey % 5] AS o_prefix,
 concat(CAST(l_orderkey // 4 AS VARCHAR), '-', CAST(l_partkey % 2 AS VARCHAR)) AS o_id,
 CASE l_linenumber % 3 WHEN 0 THEN 'semapv:ManualMappingCuration' WHEN 1 THEN 'semapv:LexicalMatching' ELSE 'semapv:UnspecifiedMatching' END AS justification,
 CAST(CAST(l_suppkey % 7 AS INT) AS VARCHAR) AS author, CASE WHEN l_tax > 0 THEN 1 - l_discount END AS row_confidence,
 coalesce(CASE WHEN l_tax > 0 THEN 1 - l_discount END, CASE WHEN l_linestatus = 'O' THEN CAST(0.9 AS DOUBLE) END) AS confidence,
 concat('set-', l_linestatus) AS ms_id, l_quantity = 50 AS is_negative FROM lineitem""",
    "sets": "SELECT * FROM (VALUES ('set-F', 'F-set', CAST(NULL AS DOUBLE), 'mesh'), ('set-O', 'O-set', 0.9, 'doid')) AS v(ms_id, title, set_confidence, source)",
    # each evidence once
    "e": """SELECT s_prefix, s_id, p, o_prefix, o_id, justification, author, row_confidence, max(confidence) AS confidence, max(ms_id) AS ms_id
 FROM f GROUP BY s_prefix, s_id, p, o_prefix, o_id, justification, author, row_confidence""",
    "t": """SELECT s_prefix, s_id, p, o_prefix, o_id, 1 - product(1 - confidence) FILTER (WHERE confidence <> 0) AS confidence, count(*) AS n_evidence
 FROM e GROUP BY s_prefix, s_id, p, o_prefix, o_id""",
    "neg": "SELECT DISTINCT s_prefix, s_id, p, o_prefix, o_id FROM f WHERE is_negative",
    "stems": """SELECT * FROM (VALUES ('doid', 'http://purl.obolibrary.org/obo/DOID_'), ('mesh', 'https://meshb.nlm.nih.gov/record/ui?ui='),
 ('umls', 'https://uts.nlm.nih.gov/uts/umls/concept/'), ('efo', 'http://www.ebi.ac.uk/efo/EFO_'), ('ncit', 'http://purl.obolibrary.org/obo/NCIT_'),
 ('skos', 'http://www.w3.org/2004/02/skos/core#'), ('oboinowl', 'http://www.geneontology.org/formats/oboInOwl#')) AS v(prefix, stem)""",
    "ids": """SELECT s_prefix, s_id, p, o_prefix, o_id, concat('mapping:', sha256(concat(a.stem, s_id, ' ', b.stem, split_part(p, ':', 2), ' ', c.stem, o_id))) AS tid
 FROM t JOIN stems a ON a.prefix = s_prefix JOIN stems b ON b.prefix = split_part(p, ':', 1) JOIN stems c ON c.prefix = o_prefix""",
    "flips": "SELECT * FROM (VALUES ('skos:exactMatch', 'skos:exactMatch'), ('skos:closeMatch', 'skos:closeMatch'), ('skos:broadMatch', 'skos:narrowMatch'), ('skos:narrowMatch', 'skos:broadMatch')) AS v(p, q)",
    # exact terms and subsets
    "exact": """SELECT DISTINCT s_prefix AS prefix, s_id AS id FROM f WHERE s_prefix IN ('doid', 'mesh', 'umls')
 UNION SELECT 'doid', concat(CAST(l_orderkey // 4 AS VARCHAR), '-2') FROM lineitem""",
    "observed": "SELECT s_prefix AS prefix, s_id AS id FROM f UNION SELECT o_prefix, o_id FROM f",
    "subset": "SELECT DISTINCT s_prefix AS prefix, s_id AS id FROM f WHERE s_prefix IN ('doid', 'mesh') AND CAST(split_part(s_id, '-', 1) AS BIGINT) % 2 = 0",
    "idx": """SELECT s_prefix AS l, o_prefix AS r, s_id AS id FROM f WHERE p IN ('skos:exactMatch', 'oboinowl:hasDbXref')
 UNION SELECT o_prefix, s_prefix, o_id FROM f WHERE p IN ('skos:exactMatch', 'oboinowl:hasDbXref')""",
    "prio": "SELECT * FROM (VALUES ('mesh', 0), ('doid', 1), ('efo', 2), ('umls', 3)) AS v(prefix, pos)",
    "n_exact": "SELECT prefix, count(*) AS n FROM exact GROUP BY prefix",
    "n_terms": """SELECT prio.prefix, coalesce(n_exact.n, o.n, 0) AS n FROM prio LEFT JOIN n_exact USING (prefix)
 LEFT JOIN (SELECT prefix, count(*) AS n FROM observed GROUP BY prefix) o USING (prefix)""",
    "sym0": """SELECT l, r, count(*) FILTER (WHERE l NOT IN (SELECT prefix FROM exact) OR EXISTS (SELECT 1 FROM exact WHERE exact.prefix = l AND exact.id = idx.id)) AS n FROM idx GROUP BY l, r""",
    "sym": """SELECT a.l, a.r, greatest(a.n, coalesce(b.n, 0)) AS n FROM sym0 a LEFT JOIN sym0 b ON a.l = b.r AND a.r = b.l
 WHERE NOT (a.l = a.r AND a.l IN (SELECT prefix FROM prio)) UNION ALL SELECT prefix, prefix, n FROM n_terms""",
    # components over all rows, by reachability
    "und": "SELECT DISTINCT concat(s_prefix, ':', s_id) AS a, concat(o_prefix, ':', o_id) AS b FROM f UNION SELECT concat(o_prefix, ':', o_id), concat(s_prefix, ':', s_id) FROM f",
    "reach": "SELECT a, b FROM und UNION SELECT reach.a, und.b FROM reach JOIN und ON reach.b = und.a",
    "cc": "SELECT a AS node, min(least(a, b)) AS component FROM reach GROUP BY a",
    "sizes": """SELECT prefixes, count(*) AS n FROM (SELECT component, list_sort(list(DISTINCT split_part(node, ':', 1))) AS prefixes FROM cc GROUP BY component) GROUP BY prefixes""",
    "psizes": """SELECT prefixes, count(*) AS n FROM (SELECT DISTINCT CASE WHEN len(prefixes) > 0 THEN component END AS c, prefixes FROM
 (SELECT component, list_sort(coalesce(list(DISTINCT split_part(node, ':', 1)) FILTER (WHERE split_part(node, ':', 1) IN (SELECT prefix FROM prio)), [])) AS prefixes FROM cc GROUP BY component)) GROUP BY prefixes""",
    # exact graph made symmetric, its star graph
    "xe": """SELECT DISTINCT s_prefix, s_id, o_prefix, o_id FROM f WHERE p = 'skos:exactMatch'
 UNION SELECT o_prefix, o_id, s_prefix, s_id FROM f WHERE p = 'skos:exactMatch'""",
    "xr": """SELECT concat(s_prefix, ':', s_id) AS a, concat(o_prefix, ':', o_id) AS b FROM xe UNION SELECT xr.a, concat(xe.o_prefix, ':', xe.o_id) FROM xr JOIN xe ON xr.b = concat(xe.s_prefix, ':', xe.s_id)""",
    "xc": "SELECT a AS node, min(least(a, b)) AS component FROM xr GROUP BY a",
    "hub": """SELECT component, arg_min(node, (pos, split_part(node, ':', 2))) AS hub FROM xc JOIN prio ON prio.prefix = split_part(node, ':', 1) GROUP BY component""",
    "star": """SELECT s_prefix, s_id, o_prefix, o_id FROM xe JOIN xc ON xc.node = concat(s_prefix, ':', s_id) JOIN hub USING (component)
 WHERE concat(o_prefix, ':', o_id) = hub AND concat(s_prefix, ':', s_id) <> hub""",
    "edges": """SELECT supplier.s_suppkey::VARCHAR AS c, 'supplier' AS cp, s_nationkey::VARCHAR AS d, 'nation' AS dp FROM supplier
 UNION ALL SELECT c_custkey::VARCHAR, 'customer', c_nationkey::VARCHAR, 'nation' FROM customer UNION ALL SELECT n_nationkey::VARCHAR, 'nation', n_regionkey::VARCHAR, 'region' FROM nation""",
    "anc": "SELECT d AS root_id, dp AS root_prefix, c AS id, cp AS prefix FROM edges WHERE dp = 'region' UNION SELECT anc.root_id, anc.root_prefix, c, cp FROM anc JOIN edges ON anc.id = d AND anc.prefix = dp",
    # the pipeline: negatives out, imprecise out, inverses in
    "g0": "SELECT * FROM t WHERE p NOT IN ('oboinowl:hasDbXref', 'skos:closeMatch') AND NOT EXISTS (SELECT 1 FROM neg WHERE neg.s_prefix = t.s_prefix AND neg.s_id = t.s_id AND neg.p = t.p AND neg.o_prefix = t.o_prefix AND neg.o_id = t.o_id)",
    "g1": """SELECT s_prefix, s_id, p, o_prefix, o_id, 1 - product(1 - c) FILTER (WHERE c <> 0) AS confidence, sum(n) AS n_evidence FROM
 (SELECT s_prefix, s_id, p, o_prefix, o_id, confidence AS c, n_evidence AS n FROM g0
  UNION ALL SELECT o_prefix, o_id, q, s_prefix, s_id, CASE WHEN confidence <> 0 THEN 1.0 END, 1 FROM g0 JOIN flips USING (p)) GROUP BY s_prefix, s_id, p, o_prefix, o_id""",
    "gu": "SELECT DISTINCT concat(s_prefix, ':', s_id) AS a, concat(o_prefix, ':', o_id) AS b FROM g1 UNION SELECT concat(o_prefix, ':', o_id), concat(s_prefix, ':', s_id) FROM g1",
    "gr": "SELECT a, b FROM gu UNION SELECT gr.a, gu.b FROM gr JOIN gu ON gr.b = gu.a",
    "gn": "SELECT a FROM gr GROUP BY a HAVING count(*) > 2 AND count(*) <= 100",
    "steps": "SELECT * FROM g1 WHERE p IN ('skos:exactMatch', 'skos:broadMatch', 'skos:narrowMatch') AND s_prefix <> o_prefix AND concat(s_prefix, ':', s_id) IN (SELECT a FROM gn)",
    "walk": """SELECT s_prefix, s_id, p, o_prefix, o_id, [s_prefix, o_prefix] AS seen, coalesce(confidence <> 0, false) AS known, 1 AS k FROM steps
 UNION ALL SELECT w.s_prefix, w.s_id, CASE WHEN w.p = 'skos:exactMatch' THEN n.p ELSE w.p END, n.o_prefix, n.o_id, list_append(w.seen, n.o_prefix), w.known OR coalesce(n.confidence <> 0, false), w.k + 1
 FROM walk w JOIN steps n ON n.s_prefix = w.o_prefix AND n.s_id = w.o_id
 WHERE w.k < 5 AND NOT list_contains(w.seen, n.o_prefix) AND (w.p = 'skos:exactMatch' OR n.p = 'skos:exactMatch' OR n.p = w.p)""",
    "chained": """SELECT s_prefix, s_id, p, o_prefix, o_id, count(*) AS n_evidence, bool_or(known) AS known FROM walk
 WHERE k > 1 AND (s_prefix < o_prefix OR (s_prefix = o_prefix AND s_id < o_id))
 AND NOT EXISTS (SELECT 1 FROM g1 WHERE g1.s_prefix = walk.s_prefix AND g1.s_id = walk.s_id AND g1.o_prefix = walk.o_prefix AND g1.o_id = walk.o_id)
 GROUP BY s_prefix, s_id, p, o_prefix, o_id""",
    # chain evidence counts by the triples it derives from; two paths over the same concepts by other predicates differ there
    "g2": """SELECT s_prefix, s_id, p, o_prefix, o_id, CASE WHEN max(CASE WHEN one THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 1 - product(1 - c) FILTER (WHERE c <> 0) END AS confidence, sum(n) AS n_evidence FROM
 (SELECT s_prefix, s_id, p, o_prefix, o_id, confidence AS c, false AS one, n_evidence AS n FROM g1
  UNION ALL SELECT s_prefix, s_id, p, o_prefix, o_id, CASE WHEN known THEN 1.0 END, known, n_evidence FROM chained
  UNION ALL SELECT o_prefix, o_id, q, s_prefix, s_id, CASE WHEN known THEN 1.0 END, known, 1 FROM chained JOIN flips USING (p)) GROUP BY s_prefix, s_id, p, o_prefix, o_id""",
    "done": """SELECT * FROM g2 WHERE s_prefix <> o_prefix AND NOT EXISTS (SELECT 1 FROM neg WHERE neg.s_prefix = g2.s_prefix AND neg.s_id = g2.s_id AND neg.p = g2.p AND neg.o_prefix = g2.o_prefix AND neg.o_id = g2.o_id)""",
}
_NEEDS = {
    "e": "f", "t": "e", "neg": "f", "ids": "t stems", "exact": "f", "observed": "f", "subset": "f", "idx": "f", "n_exact": "exact", "n_terms": "prio n_exact observed",
    "sym0": "idx exact", "sym": "sym0 prio n_terms", "und": "f", "reach": "und", "cc": "reach", "sizes": "cc", "psizes": "cc prio", "xe": "f", "xr": "xe", "xc": "xr",
    "hub": "xc prio", "star": "xe xc hub", "anc": "edges", "g0": "t neg", "g1": "g0 flips", "gu": "g1", "gr": "gu", "gn": "gr", "steps": "g1 gn", "walk": "steps",
    "chained": "walk g1", "g2": "g1 chained flips", "done": "g2 neg",
}


def sql(needs: str, select: str) -> str:
    """A query with the pieces that it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_PIECES[n]})" for n in order) + f"\n{select}"


_T = "s_prefix, s_id, p, o_prefix, o_id"


def _summed(where: str, needs: str = "f") -> str:
    """Filtered rows of the fixture, summed up by triple."""
    own = f"""SELECT {_T}, round(1 - product(1 - confidence) FILTER (WHERE confidence <> 0), 5) AS confidence, count(*) AS n_evidence FROM
 (SELECT {_T}, justification, author, row_confidence, max(confidence) AS confidence FROM f WHERE {where} GROUP BY {_T}, justification, author, row_confidence) GROUP BY {_T}"""
    return sql(needs, own)


_FLIPPED = f"SELECT o_prefix AS s_prefix, o_id AS s_id, q AS p, s_prefix AS o_prefix, s_id AS o_id, CASE WHEN confidence <> 0 THEN 1.0 END AS confidence, tid FROM t JOIN ids USING ({_T}) JOIN flips USING (p)"
_MERGED = "SELECT s_prefix, s_id, p, o_prefix, o_id, round(1 - product(1 - c) FILTER (WHERE c <> 0), 5) AS confidence, sum(n)::BIGINT AS n_evidence FROM ({}) GROUP BY s_prefix, s_id, p, o_prefix, o_id"
_MANY = """(s_prefix, o_prefix, s_id) IN (SELECT (s_prefix, o_prefix, s_id) FROM f GROUP BY s_prefix, o_prefix, s_id HAVING count(DISTINCT o_id) > 1)
 OR (s_prefix, o_prefix, o_id) IN (SELECT (s_prefix, o_prefix, o_id) FROM f GROUP BY s_prefix, o_prefix, o_id HAVING count(DISTINCT s_id) > 1)"""
_IS = "skos:exactMatch"

ORACLES: dict[str, str] = {
    "keep_prefixes": _summed("s_prefix IN ('doid', 'mesh') AND o_prefix IN ('doid', 'mesh')"),
    "keep_subject_prefixes": _summed("s_prefix IN ('doid', 'mesh')"),
    "keep_object_prefixes": _summed("o_prefix IN ('doid', 'mesh')"),
    "drop_prefixes": _summed("s_prefix NOT IN ('umls', 'ncit') AND o_prefix NOT IN ('umls', 'ncit')"),
    "drop_self_matches": _summed("s_prefix <> o_prefix"),
    "drop_imprecise": _summed("p NOT IN ('oboinowl:hasDbXref', 'skos:closeMatch')"),
    "anti_negative": _summed(f"NOT EXISTS (SELECT 1 FROM neg WHERE {' AND '.join(f'neg.{c} = f.{c}' for c in _T.split(', '))})", "f neg"),
    "minimum_confidence": _summed("confidence >= 0.95"),
    "minimum_mapping_confidence": sql("t", f"SELECT {_T}, round(confidence, 5) AS confidence, n_evidence FROM t WHERE confidence >= 0.95"),
    "subset_filter": _summed(" AND ".join(f"({x}_prefix NOT IN (SELECT prefix FROM subset) OR EXISTS (SELECT 1 FROM subset WHERE prefix = {x}_prefix AND id = {x}_id))" for x in "so"), "f subset"),
    "assemble": sql("t", f"SELECT {_T}, round(confidence, 5) AS confidence, n_evidence FROM t"),
    "evidence_dedup": sql("e", f"SELECT {_T}, justification, author, round(row_confidence, 5) AS row_confidence, round(confidence, 5) AS confidence, ms_id FROM e"),
    "tier_flags": sql("e sets", f"SELECT {_T}, coalesce(bool_or(source = s_prefix), false) AS has_primary, coalesce(bool_or(source <> s_prefix), false) AS has_secondary, false AS has_tertiary FROM e LEFT JOIN sets USING (ms_id) GROUP BY {_T}"),
    "mapping_set_titles": sql("f sets", f"SELECT {_T}, string_agg(DISTINCT title, '|' ORDER BY title) AS mapping_sets FROM f JOIN sets USING (ms_id) GROUP BY {_T}"),
    "flip": sql("t ids flips", f"SELECT {_T}, confidence, tid AS derived_from FROM ({_FLIPPED})"),
    "reverse": sql("t ids flips", _MERGED.format(f"SELECT {_T}, confidence AS c, n_evidence AS n FROM t UNION ALL SELECT {_T}, confidence, 1 FROM ({_FLIPPED})")),
    "mutate_add": sql("t", _MERGED.format(f"SELECT {_T}, confidence AS c, n_evidence AS n FROM t UNION ALL SELECT s_prefix, s_id, '{_IS}', o_prefix, o_id, CASE WHEN confidence <> 0 THEN 1 - (1 - CASE s_prefix WHEN 'doid' THEN CAST(0.99 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END) * (1 - confidence) END, 1 FROM t WHERE p = 'oboinowl:hasDbXref' AND (s_prefix, o_prefix) IN (('doid', 'mesh'), ('umls', 'efo'))")),
    "mutate_mutual": sql("t", _MERGED.format(f"SELECT {_T}, confidence AS c, n_evidence AS n FROM t UNION ALL SELECT s_prefix, s_id, '{_IS}', o_prefix, o_id, CASE WHEN confidence <> 0 THEN 1 - (1 - CAST(0.95 AS DOUBLE)) * (1 - confidence) END, 1 FROM t WHERE p = 'oboinowl:hasDbXref' AND s_prefix <> o_prefix AND s_prefix IN ('doid', 'mesh', 'umls') AND o_prefix IN ('doid', 'mesh', 'umls')")),
    "mutate_replace": sql("t", _MERGED.format(f"SELECT s_prefix, s_id, CASE WHEN m THEN '{_IS}' ELSE p END AS p, o_prefix, o_id, CASE WHEN NOT m THEN confidence WHEN confidence <> 0 THEN 1 - (1 - CAST(0.9 AS DOUBLE)) * (1 - confidence) END AS c, CASE WHEN m THEN 1 ELSE n_evidence END AS n FROM (SELECT *, p = 'oboinowl:hasDbXref' AND (s_prefix = 'doid' AND o_prefix IN ('mesh', 'efo') OR s_prefix = 'umls') AS m FROM t)")),
    "generalize": sql("t", _MERGED.format(f"SELECT s_prefix, s_id, replace(replace(p, 'skos:closeMatch', 'owl:sameAs'), 'oboinowl:hasDbXref', 'rdfs:subClassOf') AS p, o_prefix, o_id, confidence AS c, n_evidence AS n FROM t UNION ALL SELECT s_prefix, s_id, CASE p WHEN 'skos:closeMatch' THEN '{_IS}' ELSE 'skos:broadMatch' END, o_prefix, o_id, CASE WHEN confidence <> 0 THEN 1.0 END, 1 FROM t WHERE p IN ('skos:closeMatch', 'oboinowl:hasDbXref')")),
    "many_to_many": _summed(_MANY),
    "drop_many_to_many": _summed(f"NOT ({_MANY})"),
    "project_1to1": sql("f", f"SELECT {_T} FROM (SELECT *, count(DISTINCT o_id) OVER (PARTITION BY s_id) AS a, count(DISTINCT s_id) OVER (PARTITION BY o_id) AS b FROM (SELECT DISTINCT {_T} FROM f WHERE s_prefix = 'doid' AND o_prefix = 'mesh')) WHERE a = 1 AND b = 1"),
    "violations": sql("f", f"SELECT DISTINCT {_T}, CASE WHEN s_prefix IN ('doid', 'mesh', 'umls', 'efo') THEN 'invalid subject identifier' END AS problem FROM f"),
    "source_target_counts": sql("t", "SELECT s_prefix, o_prefix, count(*) AS n FROM t GROUP BY s_prefix, o_prefix"),
    "identifier_index": sql("idx", "SELECT l AS left_prefix, r AS right_prefix, id FROM idx"),
    "observed_terms": sql("observed", "SELECT prefix, id FROM observed"),
    "term_counts": sql("n_terms exact", "SELECT prefix, prefix IN (SELECT prefix FROM exact) AS exact, n FROM n_terms"),
    "symmetric_counts": sql("sym", "SELECT l AS left_prefix, r AS right_prefix, n FROM sym"),
    "asymmetric_counts": sql("f", f"SELECT s_prefix AS left_prefix, o_prefix AS right_prefix, count(DISTINCT s_id) AS n FROM f WHERE p = '{_IS}' GROUP BY s_prefix, o_prefix"),
    "counts_pivot": sql("sym prio", "SELECT l AS left_prefix, " + ", ".join(f"coalesce(max(n) FILTER (WHERE r = '{x}'), 0) AS {x}" for x in ("mesh", "doid", "efo", "umls")) + " FROM sym WHERE l IN (SELECT prefix FROM prio) AND r IN (SELECT prefix FROM prio) GROUP BY l"),
    "gains": sql("f xe", f"""SELECT coalesce(a.l, b.l) AS left_prefix, coalesce(a.r, b.r) AS right_prefix, coalesce(a.n, 0) AS raw, coalesce(b.n, 0) AS processed,
 coalesce(b.n, 0) - coalesce(a.n, 0) AS gain, round(100.0 * (coalesce(b.n, 0) - coalesce(a.n, 0)) / nullif(a.n, 0), 1) AS percent
 FROM (SELECT s_prefix AS l, o_prefix AS r, count(DISTINCT s_id) AS n FROM f WHERE p = '{_IS}' GROUP BY ALL) a FULL JOIN (SELECT s_prefix AS l, o_prefix AS r, count(DISTINCT s_id) AS n FROM xe GROUP BY ALL) b ON a.l = b.l AND a.r = b.r"""),
    "unobserved": sql("exact observed prio", "SELECT prefix, coalesce(n, 0) AS n FROM (SELECT DISTINCT prefix FROM observed WHERE prefix IN (SELECT prefix FROM prio)) LEFT JOIN (SELECT prefix, count(*) AS n FROM (SELECT * FROM exact EXCEPT SELECT * FROM observed) GROUP BY prefix) USING (prefix)"),
    "components": sql("cc", "SELECT split_part(node, ':', 1) AS prefix, split_part(node, ':', 2) AS id, component FROM cc"),
    "component_sizes": sql("psizes", "SELECT array_to_string(prefixes, ',') AS prefixes, n FROM psizes"),
    "component_sizes_all": sql("sizes", "SELECT array_to_string(prefixes, ',') AS prefixes, n FROM sizes"),
    "coverage_sizes": sql("psizes", "SELECT k::INT AS n_prefixes, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT unnest(range(1, (SELECT max(len(prefixes)) FROM psizes) + 1)) AS k UNION SELECT len(prefixes) FROM psizes) LEFT JOIN psizes ON len(prefixes) = k GROUP BY k"),
    "prioritize": sql("star f", f"SELECT DISTINCT s_prefix, s_id, '{_IS}' AS p, o_prefix, o_id FROM star"),
    "prioritize_df": sql("star", """SELECT o_orderkey, c AS curie, coalesce(star.o_prefix || ':' || star.o_id, norm, c) AS curie_prioritized FROM
 (SELECT o_orderkey, c, CASE WHEN c LIKE 'DO:%' THEN concat('doid:', substr(c, 4)) WHEN c LIKE 'doid:%' THEN c END AS norm FROM
 (SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN 'no reference' WHEN 1 THEN concat('DO:', CAST(o_orderkey // 4 AS VARCHAR), '-0') ELSE concat('doid:', CAST(o_orderkey // 4 AS VARCHAR), '-', CAST(o_custkey % 2 AS VARCHAR)) END AS c FROM orders))
 LEFT JOIN star ON norm = concat(s_prefix, ':', s_id)"""),
    "equivalence_classes": sql("observed star", "SELECT prefix, id, (prefix, id) IN (SELECT (o_prefix, o_id) FROM star) AS priority FROM observed"),
    "update_literals": sql("star", "SELECT coalesce(o_prefix, prefix) AS prefix, coalesce(o_id, id) AS id, text FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'doid' ELSE 'umls' END AS prefix, concat(CAST(p_partkey // 2 AS VARCHAR), '-', CAST(p_partkey % 2 AS VARCHAR)) AS id, p_name AS text FROM part) l LEFT JOIN star ON prefix = s_prefix AND id = s_id"),
    "reprioritize_terms": sql("star", """SELECT DISTINCT text, lower(text) AS norm_text, coalesce(o_prefix, db) AS db, coalesce(o_id, id) AS id, text AS entry_name,
 CASE WHEN o_prefix IS NULL THEN NULL ELSE db END AS source_db, CASE WHEN o_prefix IS NULL THEN NULL ELSE id END AS source_id
 FROM (SELECT p_name AS text, CASE WHEN p_partkey % 2 = 0 THEN 'doid' ELSE 'umls' END AS db, concat(CAST(p_partkey // 2 AS VARCHAR), '-', CAST(p_partkey % 2 AS VARCHAR)) AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS rank FROM part) l LEFT JOIN star ON db = s_prefix AND id = s_id
 QUALIFY row_number() OVER (PARTITION BY text, coalesce(o_prefix, db), coalesce(o_id, id) ORDER BY rank, coalesce(CASE WHEN o_prefix IS NOT NULL THEN db END, ''), coalesce(CASE WHEN o_prefix IS NOT NULL THEN id END, '')) = 1"""),
    "chains": sql("g2 g1 chained flips", f"""SELECT {_T}, bool_or(known) AS known, sum(n)::BIGINT AS n_evidence FROM (SELECT {_T}, coalesce(known, false) AS known, n_evidence AS n FROM chained
 UNION ALL SELECT o_prefix, o_id, q, s_prefix, s_id, coalesce(known, false), 1 FROM chained JOIN flips USING (p)) GROUP BY {_T}"""),
    "hierarchy_closure": sql("anc", "SELECT root_prefix, root_id, prefix, id FROM anc"),
    "hydrated_subset": sql("anc", "SELECT DISTINCT 'supplier' AS prefix, id FROM anc WHERE prefix = 'supplier' AND root_id IN ('1', '2') UNION SELECT 'region', '3'"),
    "vocabulary_terms": sql("exact subset", "SELECT prefix, id FROM exact WHERE prefix IN ('doid', 'umls') AND (prefix NOT IN (SELECT prefix FROM subset) OR (prefix, id) IN (SELECT (prefix, id) FROM subset))"),
    "summary_frame": sql("n_terms exact", "SELECT prefix, CASE WHEN prefix = 'efo' THEN 'observed' WHEN prefix IN ('doid', 'mesh') THEN 'subset' ELSE 'full' END AS status, n AS terms FROM n_terms"),
    "landscape": sql("psizes exact observed prio n_terms", """SELECT at_least_1, only_1, conserved, at_least_1 + only_1 AS reduced, total, round((total - at_least_1 - only_1)::DOUBLE / total, 5) AS reduction FROM
 (SELECT (SELECT sum(n) FROM psizes)::BIGINT AS at_least_1, (SELECT count(*) FROM (SELECT * FROM exact WHERE prefix IN (SELECT prefix FROM prio) EXCEPT SELECT * FROM observed))::BIGINT AS only_1,
 (SELECT coalesce(sum(n), 0) FROM psizes WHERE len(prefixes) = 4)::BIGINT AS conserved, (SELECT sum(n) FROM n_terms)::BIGINT AS total)"""),
    "landscape_distribution": sql("psizes exact observed prio", """SELECT k::INT AS n_prefixes, coalesce(sum(n), 0)::BIGINT AS n FROM
 (SELECT unnest(range(1, (SELECT max(len(prefixes)) FROM psizes) + 1)) AS k UNION SELECT len(prefixes) FROM psizes)
 LEFT JOIN (SELECT len(prefixes) AS k, n FROM psizes UNION ALL SELECT 1, count(*) FROM (SELECT * FROM exact WHERE prefix IN (SELECT prefix FROM prio) EXCEPT SELECT * FROM observed)) USING (k) GROUP BY k"""),
    "full_pipeline": sql("done", f"SELECT {_T}, round(confidence, 5) AS confidence, n_evidence::BIGINT AS n_evidence FROM done"),
    "triple_ids": sql("ids", f"SELECT {_T}, tid FROM ids"),
    "concept_nodes": sql("observed star f", """SELECT concat(prefix, ':', id) AS curie, prefix, CASE WHEN id LIKE '%-0' THEN concat('concept ', prefix, ':', id) ELSE '' END AS name,
 (prefix, id) IN (SELECT (o_prefix, o_id) FROM star) AS priority FROM observed UNION ALL SELECT DISTINCT concat('orcid:', author), 'orcid', '', false FROM f"""),
    "mapping_nodes": sql("e sets ids", f"""SELECT tid AS curie, 'mapping' AS prefix, p AS predicate, round(1 - product(1 - confidence) FILTER (WHERE confidence <> 0), 5) AS confidence,
 coalesce(bool_or(source = s_prefix), false) AS primary, coalesce(bool_or(source <> s_prefix), false) AS secondary, false AS tertiary FROM e JOIN ids USING ({_T}) LEFT JOIN sets USING (ms_id) GROUP BY tid, p"""),
    "evidence_nodes": sql("e", "SELECT 'sssom.record' AS prefix, 'simple' AS type, justification AS mapping_justification, round(CASE WHEN confidence <> 0 THEN confidence END, 5) AS confidence FROM e"),
    "mapping_set_nodes": sql("sets", "SELECT concat('mappingset:', md5(ms_id)) AS curie, 'mappingset' AS prefix, ms_id AS id, title, CASE ms_id WHEN 'set-O' THEN 'https://creativecommons.org/publicdomain/zero/1.0/' ELSE '' END AS license, CASE ms_id WHEN 'set-O' THEN '1' ELSE '' END AS version, coalesce(CAST(set_confidence AS DOUBLE), 1.0) AS confidence FROM sets"),
    "mapping_edges": sql("e sets", f"""SELECT concat(s_prefix, ':', s_id) AS start, p AS type, concat(o_prefix, ':', o_id) AS "end", round(1 - product(1 - confidence) FILTER (WHERE confidence <> 0), 5) AS confidence,
 coalesce(bool_or(source = s_prefix), false) AS primary, coalesce(bool_or(source <> s_prefix), false) AS secondary, false AS tertiary, string_agg(DISTINCT title, '|' ORDER BY title) AS mapping_sets FROM e LEFT JOIN sets USING (ms_id) GROUP BY {_T}"""),
    "annotated_edges": sql("ids", """SELECT tid AS start, 'owl:annotatedSource' AS type, concat(s_prefix, ':', s_id) AS "end" FROM ids UNION ALL SELECT tid, 'owl:annotatedTarget', concat(o_prefix, ':', o_id) FROM ids"""),
    "edge_counts": sql("t e", """SELECT unnest(['owl:annotatedSource', 'owl:annotatedTarget', 'hasEvidence', 'fromSet', 'hasAuthor']) AS type,
 unnest([(SELECT count(*) FROM t), (SELECT count(*) FROM t), (SELECT count(*) FROM e), (SELECT count(*) FROM e), (SELECT count(*) FROM e)]) AS n"""),
    "derived_edges": sql("t ids flips stems", f"""SELECT concat('mapping:', sha256(concat(c.stem, o_id, ' ', b.stem, split_part(q, ':', 2), ' ', a.stem, s_id))) AS mapping, tid AS source
 FROM ids JOIN flips USING (p) JOIN stems a ON a.prefix = s_prefix JOIN stems b ON b.prefix = split_part(q, ':', 1) JOIN stems c ON c.prefix = o_prefix"""),
    "sssom_rows": sql("e", """SELECT concat(s_prefix, ':', s_id) AS subject_id, CASE WHEN s_id LIKE '%-0' AND s_prefix <> 'umls' THEN concat('concept ', s_prefix, ':', s_id) END AS subject_label, p AS predicate_id,
 concat(o_prefix, ':', o_id) AS object_id, CASE WHEN o_id LIKE '%-0' AND o_prefix <> 'umls' THEN concat('concept ', o_prefix, ':', o_id) END AS object_label, justification AS mapping_justification,
 round(row_confidence, 5) AS confidence, CASE ms_id WHEN 'set-O' THEN 'https://creativecommons.org/publicdomain/zero/1.0/' END AS license, concat('orcid:', author) AS author_id, CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS derived_from FROM e"""),
    "digraph": sql("t", "SELECT s_prefix, s_id, o_prefix, o_id, string_agg(p, '|' ORDER BY p) AS predicates FROM t GROUP BY s_prefix, s_id, o_prefix, o_id"),
    "negative_pairs": sql("neg", f"SELECT concat(s_prefix, ':', s_id) AS a, concat(o_prefix, ':', o_id) AS b FROM neg WHERE p = '{_IS}' UNION SELECT concat(o_prefix, ':', o_id), concat(s_prefix, ':', s_id) FROM neg WHERE p = '{_IS}'"),
    "predicate_counts": sql("t", "SELECT p AS predicate, count(*) AS n FROM t GROUP BY p"),
    "justification_counts": sql("e", "SELECT split_part(justification, ':', 2) AS justification, count(*) AS n FROM e GROUP BY 1"),
    "evidence_type_counts": sql("e", "SELECT 'simple' AS type, count(*) AS n FROM e"),
    "mapping_set_counts": sql("e sets", "SELECT concat('mappingset:', md5(ms_id)) AS curie, title, count(*) AS n FROM e JOIN sets USING (ms_id) GROUP BY ms_id, title"),
    "concept_counts": sql("observed", "SELECT prefix, count(*) AS n, CASE prefix WHEN 'doid' THEN 'Human Disease Ontology' WHEN 'mesh' THEN 'Medical Subject Headings' WHEN 'umls' THEN 'Unified Medical Language System' WHEN 'efo' THEN 'Experimental Factor Ontology' ELSE 'NCI Thesaurus' END AS name FROM observed GROUP BY prefix"),
    "author_counts": sql("e", "SELECT concat('orcid:', author) AS curie, count(*) AS n, '' AS name FROM e GROUP BY author"),
    "node_counts": sql("e t observed star", """SELECT unnest(['Evidences', 'Mappings', 'Mapping Sets', 'Concepts', 'Equivalence Classes']) AS label,
 unnest([(SELECT count(*) FROM e), (SELECT count(*) FROM t), 2, (SELECT count(*) FROM observed) + (SELECT count(DISTINCT author) FROM e), (SELECT count(*) FROM (SELECT DISTINCT o_prefix, o_id FROM star))]) AS n"""),
    "highest_exact": sql("xe star", """SELECT curie, CASE WHEN curie LIKE '%-0' THEN concat('concept ', curie) ELSE '' END AS name, n FROM
 (SELECT concat(s_prefix, ':', s_id) AS curie, count(*) AS n FROM xe WHERE (s_prefix, s_id) IN (SELECT (o_prefix, o_id) FROM star) GROUP BY 1 ORDER BY n DESC, curie LIMIT 10)"""),
    "autocomplete": sql("observed f", """SELECT curie, name FROM (SELECT *, string_split_regex(lower(concat(name, ' ', curie)), '[\\s:]+') AS words FROM
 (SELECT concat(prefix, ':', id) AS curie, CASE WHEN id LIKE '%-0' THEN concat('concept ', prefix, ':', id) ELSE '' END AS name FROM observed UNION ALL SELECT DISTINCT concat('orcid:', author), '' FROM f))
 WHERE len(list_filter(words, lambda w: starts_with(w, '10-0') OR levenshtein(w, '10-0') <= 1)) > 0 ORDER BY len(list_filter(words, lambda w: starts_with(w, '10-0'))) = 0, curie LIMIT 100"""),
    "khop_exact": sql("xe observed", """, b AS (SELECT concat(s_prefix, ':', s_id) AS x, concat(o_prefix, ':', o_id) AS y FROM xe), q AS (SELECT concat(prefix, ':', id) AS c FROM observed),
 h AS (SELECT c AS source, c AS curie, 0 AS distance FROM q UNION SELECT source, y, distance + 1 FROM h JOIN b ON curie = x WHERE distance < 3)
 SELECT source, curie, min(distance) AS distance FROM h GROUP BY source, curie HAVING min(distance) > 0"""),
    "component_lookup": sql("und", """, h AS (SELECT 'mesh:10-0' AS curie, 0 AS d UNION SELECT b, d + 1 FROM h JOIN und ON curie = a WHERE d < 3)
 SELECT DISTINCT curie, CASE WHEN curie LIKE '%-0' THEN concat('concept ', curie) ELSE '' END AS name FROM h WHERE curie IN (SELECT a FROM und)"""),
    "component_lookup_edges": sql("und ids", """, h AS (SELECT 'mesh:10-0' AS curie, 0 AS d UNION SELECT b, d + 1 FROM h JOIN und ON curie = a WHERE d < 3)
 SELECT tid AS mapping, concat(s_prefix, ':', s_id) AS start, p AS type, concat(o_prefix, ':', o_id) AS "end" FROM ids WHERE concat(s_prefix, ':', s_id) IN (SELECT curie FROM h) AND concat(o_prefix, ':', o_id) IN (SELECT curie FROM h)"""),
    "mapping_lookup": sql("e ids", f"""SELECT tid AS mapping, concat(s_prefix, ':', s_id) AS subject, CASE WHEN s_id LIKE '%-0' THEN concat('concept ', s_prefix, ':', s_id) ELSE '' END AS subject_name, p AS predicate,
 concat(o_prefix, ':', o_id) AS object, CASE WHEN o_id LIKE '%-0' THEN concat('concept ', o_prefix, ':', o_id) ELSE '' END AS object_name, justification, round(CASE WHEN confidence <> 0 THEN confidence END, 5) AS confidence,
 concat('mappingset:', md5(ms_id)) AS mapping_set, concat('orcid:', author) AS author FROM e JOIN ids USING ({_T}) WHERE tid = (SELECT min(tid) FROM ids)"""),
    "mappings_of_set": sql("e ids", f"SELECT DISTINCT tid AS mapping, concat(s_prefix, ':', s_id) AS subject, p AS predicate, concat(o_prefix, ':', o_id) AS object FROM e JOIN ids USING ({_T}) WHERE ms_id = 'set-O' ORDER BY mapping LIMIT 10"),
    "example_mappings": sql("ids", "SELECT tid AS mapping, concat(s_prefix, ':', s_id) AS subject, concat('concept ', s_prefix, ':', s_id) AS subject_name, concat(o_prefix, ':', o_id) AS object, concat('concept ', o_prefix, ':', o_id) AS object_name FROM ids WHERE s_id LIKE '%-0' AND o_id LIKE '%-0' ORDER BY tid LIMIT 5"),
    "mapping_sets": sql("f sets", "SELECT concat('mappingset:', md5(ms_id)) AS curie, title, count(*) AS n FROM f JOIN sets USING (ms_id) GROUP BY ms_id, title"),
    "mappings_by_justification": sql("e ids", f"""SELECT DISTINCT tid AS mapping, concat(s_prefix, ':', s_id) AS start, p AS predicate, concat(o_prefix, ':', o_id) AS "end" FROM e JOIN ids USING ({_T}) WHERE justification = 'semapv:ManualMappingCuration'"""),
    "mappings_by_author": sql("e ids", f"""SELECT DISTINCT tid AS mapping, concat(s_prefix, ':', s_id) AS start, p AS predicate, concat(o_prefix, ':', o_id) AS "end" FROM e JOIN ids USING ({_T}) WHERE author = '3'"""),
    "mappings_by_confidence": sql("t ids", f"""SELECT tid AS mapping, concat(s_prefix, ':', s_id) AS start, p AS predicate, concat(o_prefix, ':', o_id) AS "end" FROM t JOIN ids USING ({_T}) WHERE round(confidence, 5) >= 0.97"""),
    "sssom_round_trip": sql("e", f"SELECT {_T}, round(1 - product(1 - row_confidence) FILTER (WHERE row_confidence <> 0), 5) AS confidence, count(*) AS n_evidence FROM e GROUP BY {_T}"),
    "jsonl_round_trip": sql("t", f"SELECT {_T}, round(confidence, 5) AS confidence, n_evidence FROM t"),
    "stream_ingest": sql("t", f"SELECT {_T}, round(confidence, 5) AS confidence, n_evidence FROM t"),
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "messy_xrefs": """SELECT 'clo' AS s_prefix, lpad(p_partkey::VARCHAR, 7, '0') AS s_id, 'oboinowl:hasDbXref' AS p, o_prefix, o_id, CAST(0.8 AS DOUBLE) AS confidence FROM
 (SELECT p_partkey, unnest(['cosmic.cell', 'cellosaurus', 'hms.lincs.cell', 'dsmz', 'chembl.cell']) AS o_prefix,
  unnest([p_partkey::VARCHAR, lpad(p_partkey::VARCHAR, 4, '0'), p_partkey::VARCHAR, concat('ACC-', p_partkey), concat('CHEMBL', p_partkey)]) AS o_id FROM part)""",
    "clinical_triangles": """SELECT * FROM (SELECT 'mesh' AS s_prefix, concat('D', s_suppkey) AS s_id, 'skos:exactMatch' AS p, 'snomedct' AS o_prefix, s_suppkey::VARCHAR AS o_id, 'semapv:UnspecifiedMatching' AS justification FROM supplier
 UNION ALL SELECT 'mesh', concat('D', s_suppkey), 'skos:exactMatch', 'icd10cm', concat('A', lpad((s_suppkey % 100)::VARCHAR, 2, '0')), 'semapv:MappingChaining' FROM supplier WHERE s_suppkey % 3 > 0
 UNION ALL SELECT 'icd10cm', concat('A', lpad((s_suppkey % 100)::VARCHAR, 2, '0')), 'skos:exactMatch', 'snomedct', s_suppkey::VARCHAR, 'semapv:UnspecifiedMatching' FROM supplier WHERE s_suppkey % 3 > 0)""",
    "prefix_summary": sql("observed", "SELECT DISTINCT prefix, CASE prefix WHEN 'doid' THEN 'Human Disease Ontology' WHEN 'mesh' THEN 'Medical Subject Headings' WHEN 'umls' THEN 'Unified Medical Language System' WHEN 'efo' THEN 'Experimental Factor Ontology' ELSE 'NCI Thesaurus' END AS name FROM observed"),
}
