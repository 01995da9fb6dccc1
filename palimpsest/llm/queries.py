"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from . import leakage, mixing, mojibake, topn

P2 = """
WITH norm AS (
  SELECT regexp_replace(regexp_replace(replace(file_path, chr(92), '/'), '/+', '/', 'g'), '^(\\./)+', '') AS file_path,
    trim(regexp_extract(lower(trim(symbol_dna_id, ' \t\n\r')), '[^:]*$'), ' \t\n\r') AS symbol_dna_id, impact_score + 0.0 AS score
  FROM symbol_history WHERE isfinite(impact_score) AND lower(trim(symbol_dna_id, ' \t\n\r')) NOT LIKE 'unknown:%'),
best AS (SELECT file_path, symbol_dna_id, max(score) AS score FROM norm WHERE ltrim(symbol_dna_id, '0') <> '' AND file_path IS NOT NULL GROUP BY ALL)
SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, symbol_dna_id) AS rank_no, symbol_dna_id FROM best QUALIFY rank_no <= 5
"""

P7 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, list_filter(regexp_split_to_array(lower(regexp_replace(item_text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
"""

QUERIES = {
    "p2_found": (topn.p2_found, P2),
    "p7_found": (leakage.p7_found, P7),
    "p7_leaked_items": (leakage.p7_leaked_items, None),
    "p8_mixture": (mixing.p8_mixture, None),
    "p8_shares": (mixing.p8_shares, None),
    "p9_found": (mojibake.p9_found, None),
    "p9_restored": (mojibake.p9_restored, None),
    "p9_mappings": (mojibake.p9_mappings, None),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
