"""Queries of the data-quality operators, with SQL where SQL can say the same."""

from __future__ import annotations

from ..operators import hierarchy, history, instants, nested, references

#: Normal forms shared by the SQL below.
MACROS = """
commit_norm AS (SELECT lower(trim(sha, ' \t\n\r')) AS sha, lower(trim(parent, ' \t\n\r')) AS parent, load_batch FROM commits_metadata),
commit_row AS (SELECT sha, load_batch, min(CASE WHEN parent LIKE 'unknown:%' OR ltrim(parent, '0') = '' THEN NULL ELSE parent END) AS parent
  FROM commit_norm c WHERE load_batch = (SELECT max(load_batch) FROM commit_norm d WHERE d.sha = c.sha) GROUP BY ALL),
shas AS (SELECT DISTINCT sha FROM commit_row)
"""


def _dna(c: str) -> str:
    last = f"trim(regexp_extract(lower(trim({c}, ' \t\n\r')), '[^:]*$'), ' \t\n\r')"
    return f"CASE WHEN lower(trim({c}, ' \t\n\r')) LIKE 'unknown:%' OR ltrim({last}, '0') = '' THEN NULL ELSE {last} END"


P1 = f"""
WITH {MACROS},
alive AS (
  SELECT kind, key FROM (
    SELECT 'commit' AS kind, sha AS key, max(load_batch) AS last FROM commit_norm GROUP BY ALL
    UNION ALL SELECT 'dna', {_dna("dna_id")}, max(load_batch) FROM symbol_versions GROUP BY ALL)
  LEFT JOIN (SELECT key_kind AS kind, lower(trim(purged_key)) AS key, max(purged_batch) AS purged FROM purged_keys GROUP BY ALL) USING (kind, key)
  WHERE purged IS NULL OR last > purged),
commit_refs AS (
  SELECT 'files' AS table_name, load_batch, CAST(id AS VARCHAR) AS row_key, lower(trim(sha, ' \t\n\r')) AS ref FROM files
  UNION ALL SELECT 'commits_metadata', load_batch, sha, parent FROM commit_row),
short AS (
  SELECT ref, CASE WHEN count(sha) = 1 THEN min(sha) END AS full_sha FROM (SELECT DISTINCT ref FROM commit_refs WHERE length(ref) < 40) LEFT JOIN shas ON starts_with(sha, ref) GROUP BY ref),
refs AS (
  SELECT table_name, load_batch, row_key, 'commit' AS kind, coalesce(full_sha, ref) AS key FROM commit_refs LEFT JOIN short USING (ref) WHERE ref NOT LIKE 'unknown:%' AND ltrim(ref, '0') <> ''
  UNION ALL SELECT 'symbols', load_batch, CAST(id AS VARCHAR), 'dna', {_dna("dna_id")} FROM symbols
  UNION ALL SELECT 'dna_decision_log', load_batch, CAST(id AS VARCHAR), 'dna', {_dna("dna_id")} FROM dna_decision_log)
"""
_LOST = " FROM refs WHERE key IS NOT NULL AND (kind, key) NOT IN (SELECT (kind, key) FROM alive WHERE key IS NOT NULL)"
P1_FOUND = P1 + "SELECT DISTINCT table_name, CAST(load_batch AS BIGINT) AS load_batch, row_key" + _LOST
P1_PERIODS = P1 + "SELECT table_name, CAST(load_batch AS BIGINT) AS load_batch, count(DISTINCT (kind, key)) AS orphan_keys, count(*) AS orphan_references" + _LOST + " GROUP BY ALL"

P4 = f"""
WITH RECURSIVE {MACROS},
short AS (SELECT parent AS ref, CASE WHEN count(s.sha) = 1 THEN min(s.sha) END AS full_sha FROM (SELECT DISTINCT parent FROM commit_row WHERE length(parent) < 40) LEFT JOIN shas s ON starts_with(s.sha, parent) GROUP BY parent),
edge AS (SELECT c.sha AS node, p.sha AS parent FROM commit_row c LEFT JOIN short ON c.parent = short.ref LEFT JOIN shas p ON p.sha = coalesce(short.full_sha, c.parent)),
down AS (SELECT node, node AS root, CAST(0 AS BIGINT) AS depth FROM edge WHERE parent IS NULL UNION ALL SELECT e.node, d.root, d.depth + 1 FROM down d JOIN edge e ON e.parent = d.node),
lost AS (SELECT node, parent FROM edge WHERE node NOT IN (SELECT node FROM down)),
reach AS (SELECT node, parent AS far FROM lost UNION SELECT r.node, l.parent FROM reach r JOIN lost l ON l.node = r.far),
ring AS (SELECT DISTINCT node FROM reach WHERE node = far)
SELECT node AS sha, root AS root_sha, depth FROM down
UNION ALL SELECT node, min(far), -1 FROM reach WHERE far IN (SELECT node FROM ring) GROUP BY node
"""

P4_TREE = (
    P4[: P4.index("down AS (")]
    + f"""down AS (SELECT node, node AS root, CAST(0 AS BIGINT) AS depth, node AS path, CAST(NULL AS VARCHAR) AS path_after, node AS whole FROM edge WHERE parent IS NULL
  UNION ALL SELECT e.node, d.root, d.depth + 1, CASE WHEN (d.depth + 1) % {hierarchy.PATH_BLOCK} = 0 THEN e.node ELSE d.path || '/' || e.node END, CASE WHEN (d.depth + 1) % {hierarchy.PATH_BLOCK} = 0 THEN d.node ELSE d.path_after END, d.whole || '/' || e.node FROM down d JOIN edge e ON e.parent = d.node),
lost AS (SELECT node, parent FROM edge WHERE node NOT IN (SELECT node FROM down)),
reach AS (SELECT node, parent AS far FROM lost UNION SELECT r.node, l.parent FROM reach r JOIN lost l ON l.node = r.far),
ring AS (SELECT DISTINCT node FROM reach WHERE node = far),
above AS (SELECT node, parent AS over_ FROM edge WHERE parent IS NOT NULL AND node IN (SELECT node FROM down) UNION ALL SELECT a.node, e.parent FROM above a JOIN edge e ON e.node = a.over_ WHERE e.parent IS NOT NULL),
below AS (SELECT over_ AS node, count(*) AS n FROM above GROUP BY over_),
placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY whole) - 1 AS pre FROM down),
loops AS (SELECT node, min(far) AS root FROM reach WHERE far IN (SELECT node FROM ring) GROUP BY node)
SELECT node AS sha, root AS root_sha, depth, pre, pre + coalesce(n, 0) AS last, coalesce(n, 0) AS n_descendants, path, path_after, false AS back_edge FROM placed LEFT JOIN below USING (node)
UNION ALL SELECT l.node, l.root, -1, NULL, NULL, NULL, NULL, NULL, l.node IN (SELECT node FROM ring) AND e.parent = l.root FROM loops l JOIN edge e USING (node)
"""
)

P6_ROWS = f"""
WITH norm AS (SELECT {_dna("dna_id")} AS dna_id, id, recorded_at, lower(signature_hash) AS s, lower(body_hash) AS b,
    regexp_replace(regexp_replace(replace(path, chr(92), '/'), '/+', '/', 'g'), '^(\\./)+', '') AS p FROM symbol_versions),
one AS (SELECT * FROM norm WHERE dna_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dna_id, recorded_at ORDER BY id DESC) = 1),
filled AS (SELECT dna_id, id, recorded_at, last_value(s IGNORE NULLS) OVER w AS s, last_value(b IGNORE NULLS) OVER w AS b, p FROM one WINDOW w AS (PARTITION BY dna_id ORDER BY recorded_at)),
marked AS (SELECT *, lag(s) OVER w IS DISTINCT FROM s OR lag(b) OVER w IS DISTINCT FROM b OR lag(p) OVER w IS DISTINCT FROM p OR lag(id) OVER w IS NULL AS opens FROM filled WINDOW w AS (PARTITION BY dna_id ORDER BY recorded_at)),
opened AS (SELECT *, lead(id) OVER w AS next_id, lead(recorded_at) OVER w AS next_at FROM marked WHERE opens WINDOW w AS (PARTITION BY dna_id ORDER BY recorded_at))
"""
P6 = P6_ROWS + "SELECT dna_id, id AS first_row_id, coalesce(next_id, -1) AS next_row_id FROM opened"
P6_HISTORY = P6_ROWS + "SELECT dna_id, recorded_at AT TIME ZONE 'UTC' AS valid_from, next_at AT TIME ZONE 'UTC' AS valid_to, s AS signature_hash, b AS body_hash, p AS path FROM opened"

_KEY = "CASE WHEN lower(trim(sha, ' \t\n\r')) LIKE 'unknown:%' OR ltrim(lower(trim(sha, ' \t\n\r')), '0') = '' THEN NULL ELSE lower(trim(sha, ' \t\n\r')) END"
_FENCED = r"```[ \t]*[A-Za-z0-9_+.-]*\s*([\s\S]*?)```"
P3_FOUND = f"""
WITH RECURSIVE v AS (
  SELECT 'commits_analysis.raw_llm_json' AS source_field, {_KEY} AS record_key, raw_llm_json AS value FROM commits_analysis UNION SELECT 'commits_analysis.hotspots_json', {_KEY}, hotspots_json FROM commits_analysis
  UNION SELECT 'hybrid_facts.serialized_fact', CAST(id AS VARCHAR), serialized_fact FROM hybrid_facts UNION SELECT 'hybrid_facts.timeline_json', CAST(id AS VARCHAR), timeline_json FROM hybrid_facts),
opened AS (SELECT source_field, record_key, CASE WHEN json_valid(value) AND json_type(value) = 'VARCHAR' THEN json_extract_string(value, '$') ELSE value END AS value FROM v WHERE value IS NOT NULL AND record_key IS NOT NULL),
fenced AS (SELECT source_field, record_key, CASE WHEN json_valid(value) THEN value ELSE trim(regexp_extract(value, '{_FENCED}', 1), ' \t\n\r') END AS value FROM opened),
doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, source_field, record_key, value FROM fenced WHERE json_valid(value) AND json_type(value) IN ('OBJECT', 'ARRAY')),
tree AS MATERIALIZED (SELECT rid, t.id, t.parent, t.key, t.type FROM doc, json_tree(doc.value) t),
walk AS (SELECT rid, id, type, true AS top, '' AS node_path, '' AS parent_path FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.rid, t.id, t.type, false, CASE WHEN w.top THEN t.key ELSE w.node_path || '/' || t.key END, CASE WHEN w.type = 'OBJECT' THEN w.node_path ELSE w.parent_path END FROM walk w JOIN tree t ON t.rid = w.rid AND t.parent = w.id)
SELECT source_field, record_key, node_path, parent_path FROM walk JOIN doc USING (rid) WHERE type = 'OBJECT' AND NOT top
"""

QUERIES = {
    "p1_found": (references.p1_found, P1_FOUND),
    "p1_orphans_per_period": (references.p1_orphans_per_period, P1_PERIODS),
    "p3_found": (nested.p3_found, P3_FOUND),
    "p3_variants": (nested.p3_variants, None),
    "p3_typed": (nested.p3_typed, None),
    "p3_symbols": (nested.p3_symbols, None),
    "p3_evidence": (nested.p3_evidence, None),
    "p4_found": (hierarchy.p4_found, P4),
    "p4_tree": (hierarchy.p4_tree, P4_TREE),
    "p5_found": (instants.p5_found, None),
    "p5_masks": (instants.p5_masks, None),
    "p5_zone_transitions": (instants.p5_zone_transitions, None),
    "p6_found": (history.p6_found, P6),
    "p6_history": (history.p6_history, P6_HISTORY),
}
