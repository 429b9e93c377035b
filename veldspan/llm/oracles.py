"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH i AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[k:k + 12], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT l FROM win),
d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
p AS (
  SELECT doc_id, l, k, array_to_string(w[k:k + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, sizes WHERE len(w) >= l)
),
h AS (SELECT doc_id, p.l AS l, k, item_id FROM p JOIN win ON p.s = win.s AND p.l = win.l),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP9 = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
hot AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM hot)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM hot)), '')) AS kept_sha256
FROM l GROUP BY doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
g AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(k, k + 13)) AS i FROM x JOIN f USING (s) WHERE first < doc_id)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN g ON g.doc_id = d.doc_id AND g.i = p.i GROUP BY d.doc_id, len(d.w)
"""


def _fence(metric: str, tail: int, level: str) -> str:
    """Both tails' quantiles and the median of a metric's buckets by order."""

    def at(percent: int) -> str:
        return f"list(b_{metric} ORDER BY b_{metric})[greatest(1, (count(*) * {percent} + 99) // 100)]"

    least = lambda b: f"({b} - ({b} >> 7) * 128) << ({b} >> 7)"
    most = lambda b: f"(({b} - ({b} >> 7) * 128 + 1) << ({b} >> 7)) - 1"
    return f"{least(at(tail))} AS low_{metric}_{level}, {least(at(50))} AS mid_{metric}_{level}, {most(at(100 - tail))} AS high_{metric}_{level}"


def _op1() -> str:
    from veldspan.llm.quality import BITS, RULES

    metrics = ", ".join(f"{r.value.replace(' DIV ', ' // ')} AS m_{r.metric}" for r in RULES)
    buckets = ", ".join(f"greatest(0, length(bin(m_{r.metric})) - {BITS}) * {1 << BITS} + (m_{r.metric} >> greatest(0, length(bin(m_{r.metric})) - {BITS})) AS b_{r.metric}" for r in RULES)
    levels = {"a": "lang, source", "b": "lang", "c": ""}
    fences = ",\n".join(
        f"f{k} AS (SELECT {g + ', ' if g else ''}count(*) AS size_{k}, {', '.join(_fence(r.metric, r.tail, k) for r in RULES)} FROM b{' GROUP BY ' + g if g else ''})" for k, g in levels.items()
    )
    beyond = []
    for r in RULES:
        low, mid, high = (f"CASE WHEN size_a >= 100 THEN {q}_{r.metric}_a WHEN size_b >= 100 THEN {q}_{r.metric}_b ELSE {q}_{r.metric}_c END" for q in ("low", "mid", "high"))
        beyond += [f"m_{r.metric} < ({low}) - greatest({r.floor}, ({mid}) - ({low})) * {r.reach}"] * r.low
        beyond += [f"m_{r.metric} > ({high}) + greatest({r.floor}, ({high}) - ({mid})) * {r.reach}"] * r.high
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, k, w[k:k + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM x) WHERE c > 1) GROUP BY doc_id),
s AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
),
m0 AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM s),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {metrics} FROM m0),
b AS (SELECT lang, source, {buckets} FROM m WHERE NOT base_failed),
{fences}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({' OR '.join(beyond)}, false) AS kept
FROM m LEFT JOIN fa ON fa.lang IS NOT DISTINCT FROM m.lang AND fa.source IS NOT DISTINCT FROM m.source LEFT JOIN fb ON fb.lang IS NOT DISTINCT FROM m.lang CROSS JOIN fc
"""


OP4 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, source, size, -ln((CAST(concat('0x', substr(md5(concat('mix|', doc_id, '|', md5(t))), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)
    / (greatest(floor(20 - 20 * len(regexp_extract_all(t, '[#*$%&|<>0-9]')) / greatest(length(t), 1)), 1) / 20.0) AS sort_key FROM d
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
l AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM w
),
c AS (SELECT *, source_size * 200 * rest_weight <= weight * (total * 150 - before * 200) AS capped FROM l),
a AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(source_size * 2 AS DOUBLE) ELSE
    CAST(weight * (total * 150 - sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER () * 200) AS DOUBLE) / CAST(100 * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target FROM c
),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM a),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY sort_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CAST(o.before + size / 2 <= target - epochs * source_size AS INT)) AS BIGINT) AS taken
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""

ORACLES: dict[str, str] = {"op1_quality_rules": _op1(), "op4_source_mix": OP4, "op7_substring_dedup": OP7, "op9_line_dedup": OP9, "op10_decontaminate": OP10}
