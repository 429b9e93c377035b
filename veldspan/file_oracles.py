"""DuckDB SQL for the queries over files, jobs and reports."""

from __future__ import annotations

from veldspan.oracles import _FLIPPED, _T, ORACLES as _OWN
from veldspan.oracles import _summed, sql

_EXACT, _SAME = "skos:exactMatch", "semapv:UnspecifiedMatching"
_LIMITED = "AS is_negative FROM lineitem"


def _rows(where: str, s_prefix: str, s_id: str, o_prefix: str, o_id: str, *, p: str = _EXACT, justification: str = f"'{_SAME}'", confidence: float = 0.99) -> str:
    """Facts made from parts, of number ``k``."""
    return (
        f"SELECT {s_prefix} AS s_prefix, CAST({s_id} AS VARCHAR) AS s_id, '{p}' AS p, {o_prefix} AS o_prefix, CAST({o_id} AS VARCHAR) AS o_id, {justification} AS justification,"
        f" CAST({confidence} AS DOUBLE) AS confidence FROM (SELECT p_partkey AS k FROM part) WHERE {where}"
    )


_CODE = "concat('A', lpad((k % 100)::VARCHAR, 2, '0'))"
_LABEL = "CASE WHEN {c} LIKE '%-0' AND {c} NOT LIKE 'umls:%' THEN concat('concept ', {c}) END"
# index, counts and diagonal of the symmetric exact mappings
_PROCESSED = """, jdx AS (SELECT s_prefix AS l, o_prefix AS r, s_id AS id FROM xe UNION SELECT o_prefix, s_prefix, o_id FROM xe),
 sum0 AS (SELECT l, r, count(*) FILTER (WHERE l NOT IN (SELECT prefix FROM exact) OR EXISTS (SELECT 1 FROM exact WHERE exact.prefix = l AND exact.id = jdx.id)) AS n FROM jdx GROUP BY l, r),
 sums AS (SELECT a.l, a.r, greatest(a.n, coalesce(b.n, 0)) AS n FROM sum0 a LEFT JOIN sum0 b ON a.l = b.r AND a.r = b.l
 WHERE NOT (a.l = a.r AND a.l IN (SELECT prefix FROM prio)) UNION ALL SELECT prefix, prefix, n FROM n_terms)
"""
_PAIR = _OWN["landscape"].replace("('mesh', 0), ('doid', 1), ('efo', 2), ('umls', 3)", "('mesh', 0), ('doid', 1)").replace("len(prefixes) = 4", "len(prefixes) = 2")
_NOT_NEGATIVE = " AND ".join(
    f"NOT EXISTS (SELECT 1 FROM neg WHERE {' AND '.join(f'neg.{a} = f.{b}' for a, b in zip(_T.split(', '), other.split(', '), strict=True))})" for other in (_T, "o_prefix, o_id, p, s_prefix, s_id")
)

ORACLES: dict[str, str] = {
    "parquet_round_trip": _OWN["assemble"],
    "nested_round_trip": _OWN["assemble"],
    "digraph_round_trip": _summed("s_prefix <> 'umls'"),
    "sssom_gzip_round_trip": _OWN["sssom_round_trip"],
    "sssom_rejected": """SELECT concat(CASE WHEN k % 5 = 0 THEN 'nowhere' ELSE 'doid' END, ':', k) AS subject_id, CASE WHEN k % 7 > 0 THEN 'skos:exactMatch' END AS predicate_id, concat('mesh:D', k) AS object_id,
 CASE WHEN k % 11 = 0 THEN '1.5' ELSE '0.5' END AS confidence FROM (SELECT p_partkey AS k FROM part) WHERE k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0""",
    "ontology_xrefs": _rows("k % 3 > 0 AND k % 7 > 0", "'doid'", "k", "'mesh'", "concat('D', k)", p="oboinowl:hasDbXref", confidence=0.9),
    "lexical_table": _rows("k % 4 > 0", "'doid'", "k", "'mesh'", "concat('D', k)", justification="'semapv:LexicalMatching'", confidence=0.95),
    "family_equivalences": _rows(
        "k % 4 > 1", "'fplx'", "concat('family_', k)", "CASE k % 4 WHEN 2 THEN 'go' ELSE 'reactome' END", "CASE k % 4 WHEN 2 THEN lpad(k::VARCHAR, 7, '0') ELSE concat('R-HSA-', k) END",
        justification="'semapv:ManualMappingCuration'",
    ),
    "thesaurus_pairs": " UNION ALL ".join((
        _rows("k < 100000", "'ncit'", "concat('C', k)", "'hgnc'", "k"), _rows("true", "'ncit'", "concat('C', k)", "'go'", "lpad(k::VARCHAR, 7, '0')"),
        _rows("true", "'ncit'", "concat('C', k)", "'chebi'", "k"), _rows("true", "'ncit'", "concat('C', k)", "'uniprot'", "concat('P', lpad(k::VARCHAR, 6, '0'))"),
    )),
    "gene_table": " UNION ALL ".join((
        _rows("k % 10 > 0 AND k % 3 > 0", "'omim'", "100000 + k", "'ncbigene'", "k"), _rows("k % 10 > 0 AND k % 4 > 0", "'omim'", "100000 + k", "'ensembl'", "concat('ENSG', lpad(k::VARCHAR, 11, '0'))"),
    )),
    "compound_names": _rows("k % 50 >= 10", "'pubchem.compound'", "k", "'mesh'", "concat('D', k % 50)"),
    "clinical_pairs": _rows(
        "k % 4 < 3", "'doid'", "k", "['mesh', 'icd10cm', 'snomedct'][1 + k % 4]", f"[concat('D', k), {_CODE}, k::VARCHAR][1 + k % 4]", justification="'semapv:MappingChaining'", confidence=0.8,
    ),
    "clinical_triangles_by_code": " UNION ALL ".join((
        _rows("true", "'mesh'", "concat('D', k)", "'snomedct'", "k", justification="'semapv:MappingChaining'", confidence=0.8),
        _rows("k % 3 > 0", "'mesh'", "concat('D', k)", "'icd10cm'", _CODE, confidence=0.8), _rows("k % 3 > 0", "'icd10cm'", _CODE, "'snomedct'", "k", confidence=0.8),
    )),
    "pathway_equivalences": _rows(
        "k % 5 > 0", "CASE WHEN k % 2 = 0 THEN 'kegg.pathway' ELSE 'reactome' END", "CASE WHEN k % 2 = 0 THEN concat('hsa', lpad(k::VARCHAR, 5, '0')) ELSE concat('R-HSA-', k) END",
        "'wikipathways'", "concat('WP', k)", justification="'semapv:ManualMappingCuration'",
    ),
    "property_values": _rows("k % 6 > 0", "'wikidata'", "concat('Q', k)", "'go'", "lpad(k::VARCHAR, 7, '0')"),
    "catalog_union": """SELECT 'curated' AS ms_id, ['doid','mesh','umls','efo'][1 + l_linenumber % 4] AS s_prefix, ['doid','mesh','umls','efo','ncit'][1 + l_partkey % 5] AS o_prefix, count(*) AS n
 FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY ALL""",
    "parsed_references": sql("stems", """SELECT k, concat(prefix, ':', id) AS curie, concat(stem, id) AS uri, concat(prefix, ':', id) AS back FROM
 (SELECT p_partkey AS k, ['doid', 'mesh', 'nowhere', 'umls'][1 + p_partkey % 4] AS own, CASE WHEN p_partkey % 9 = 0 THEN 'a:b' ELSE p_partkey::VARCHAR END AS id FROM part) LEFT JOIN stems ON prefix = own""").replace(
        "concat(prefix, ':', id)", "prefix || ':' || id").replace("concat(stem, id)", "stem || id"),
    "job_processed": _OWN["full_pipeline"],
    "job_raw": _OWN["assemble"],
    "job_filtered": _OWN["full_pipeline"].replace(_LIMITED, f"{_LIMITED} WHERE l_linenumber % 4 < 2 AND l_partkey % 5 < 2"),
    "raw_database_summary": """SELECT 'custom' AS kind, concat('line', l_linenumber) AS key, false AS cached, false AS failed, count(*) AS n, count(DISTINCT concat(l_orderkey // 4, '-', l_suppkey % 2)) AS subjects
 FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_linenumber UNION ALL SELECT 'custom', 'down', false, true, 0, NULL""",
    "overlaps": sql("sym xe star", f"""{_PROCESSED} SELECT l AS left_prefix, r AS right_prefix, n, 'raw' AS level FROM sym UNION ALL SELECT l, r, n, 'processed' FROM sums
 UNION ALL SELECT s_prefix, o_prefix, count(DISTINCT s_id), 'priority' FROM star GROUP BY s_prefix, o_prefix"""),
    "meta_analysis": f"SELECT 'all' AS domain, * FROM ({_OWN['landscape']}) UNION ALL SELECT 'pair', * FROM ({_PAIR})",
    "upset": sql("psizes exact observed prio", f"""SELECT {', '.join(f"list_contains(prefixes, '{x}') AS {x}" for x in ('mesh', 'doid', 'efo', 'umls'))}, sum(n)::BIGINT AS n FROM
 (SELECT prefixes, n FROM psizes UNION ALL SELECT [prefix], count(*) FROM (SELECT * FROM exact WHERE prefix IN (SELECT prefix FROM prio) EXCEPT SELECT * FROM observed) GROUP BY prefix) GROUP BY prefixes HAVING sum(n) > 0"""),
    "source_summary": sql("n_terms observed", "SELECT ((SELECT sum(n) FROM n_terms) + (SELECT count(*) FROM observed WHERE prefix = 'ncit'))::BIGINT AS total_terms, 1::BIGINT AS without_terms"),
    "repeated_subjects": sql("f", "SELECT s_prefix, s_id, count(*) AS n FROM (SELECT DISTINCT s_prefix, s_id, o_prefix, o_id FROM f) GROUP BY s_prefix, s_id HAVING count(*) > 1"),
    "star_order": sql("star prio", "SELECT s_prefix, s_id, o_prefix, o_id, pos::BIGINT AS place FROM (SELECT DISTINCT s_prefix, s_id, o_prefix, o_id FROM star) JOIN prio ON prefix = o_prefix"),
    "anti_negative_symmetric": _summed(_NOT_NEGATIVE, "f neg"),
    "reasoned_rows": sql("t ids flips", f"""SELECT subject_id, {_LABEL.format(c='subject_id')} AS subject_label, p AS predicate_id, object_id, {_LABEL.format(c='object_id')} AS object_label,
 'semapv:MappingInversion' AS mapping_justification, confidence, 'https://creativecommons.org/publicdomain/zero/1.0/' AS license, tid AS derived_from FROM
 (SELECT concat(s_prefix, ':', s_id) AS subject_id, p, concat(o_prefix, ':', o_id) AS object_id, confidence, tid FROM ({_FLIPPED}))"""),
    "mapping_edge_files": f"""SELECT start, type, "end", confidence, CAST("primary" AS VARCHAR) AS "primary", CAST(secondary AS VARCHAR) AS secondary, CAST(tertiary AS VARCHAR) AS tertiary, mapping_sets FROM ({_OWN['mapping_edges']})""",
    "concept_files": sql("observed f", """SELECT concat(prefix, ':', id) AS curie, prefix, CASE WHEN id LIKE '%-0' THEN concat('concept ', prefix, ':', id) ELSE '' END AS name, 'false' AS priority FROM observed
 UNION ALL SELECT DISTINCT concat('orcid:', author), 'orcid', '', 'false' FROM f"""),
    "cytoscape": sql("xe ids", f""", b AS (SELECT concat(s_prefix, ':', s_id) AS x, concat(o_prefix, ':', o_id) AS y FROM xe), h AS (SELECT 'mesh:10-0' AS c, 0 AS d UNION SELECT y, d + 1 FROM h JOIN b ON c = x WHERE d < 3),
 near AS (SELECT DISTINCT c FROM h) SELECT c AS id, CASE WHEN c LIKE '%-0' THEN concat('concept ', c) ELSE c END AS label, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS predicate
 FROM near WHERE c IN (SELECT x FROM b) UNION ALL SELECT tid, NULL, concat(s_prefix, ':', s_id), concat(o_prefix, ':', o_id), p FROM ids
 WHERE p = '{_EXACT}' AND concat(s_prefix, ':', s_id) IN (SELECT c FROM near) AND concat(o_prefix, ':', o_id) IN (SELECT c FROM near)"""),
    "mapping_set_lookup": "SELECT concat('mappingset:', md5('set-O')) AS curie, 'set-O' AS id, 'O-set' AS title, CAST(0.9 AS DOUBLE) AS confidence",
    "example_concept": sql("observed", """, c AS (SELECT concat(prefix, ':', id) AS curie FROM observed)
 (SELECT curie, concat('concept ', curie) AS name FROM c WHERE curie LIKE '%-0' ORDER BY curie LIMIT 1) UNION ALL SELECT curie, '' FROM c WHERE curie = 'umls:10-1'"""),
    "evidence_lookup": sql("e", "SELECT justification AS mapping_justification, count(*) AS n, count(*) AS n_ids FROM e GROUP BY justification"),
    "pairs_of_concepts": sql("star", "SELECT DISTINCT concat(s_prefix, ':', s_id) AS s_curie, concat(o_prefix, ':', o_id) AS o_curie FROM star"),
    "written_negatives": f"""SELECT concat(s_prefix, ':', s_id) AS subject, p, concat(o_prefix, ':', o_id) AS object, confidence, n_evidence FROM ({_summed(f'''s_id LIKE '10-%' AND NOT (p = '{_EXACT}'
 AND (concat(s_prefix, ':', s_id), concat(o_prefix, ':', o_id)) IN (('mesh:10-0', 'doid:10-0'), ('doid:10-0', 'mesh:10-0'), ('doid:10-1', 'umls:10-0'), ('umls:10-0', 'doid:10-1')))''')})""".replace(
        _LIMITED, f"{_LIMITED} WHERE l_orderkey < 400"),
    "observed_by_set": sql("f", "SELECT ms_id, count(*) AS n FROM f GROUP BY ms_id"),
}
