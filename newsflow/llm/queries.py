"""The registered query of every operator, and its SQL form where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_sharding": "op1_sharding",
    "op2_substring_dedup": "op2_substring",
    "op3_decontamination": "op3_decontamination",
    "op4_toxicity": "op4_toxicity",
    "op5_chat": "op5_chat",
    "op6_near_dedup": "op6_neardup",
    "op7_quality_rules": "op7_quality",
    "op8_language": "op8_language",
    "op9_packing": "op9_packing",
    "op10_html": "op10_html",
    "op11_licenses": "op11_licenses",
    "op12_whitening": "op12_whitening",
    "op13_alignment": "op13_alignment",
}

QUERIES = {name: getattr(importlib.import_module(f"newsflow.llm.{m}"), name) for name, m in MODULES.items()}
ORACLE: dict[str, str] = {
    "op3_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM bi
), di AS (
  SELECT rid, w, s.l AS l, unnest(range(1, len(w) - s.l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) s
), hits AS (
  SELECT di.rid, di.i, di.l, bw.item FROM di JOIN bw ON bw.l = di.l AND bw.win = array_to_string(di.w[di.i:di.i + di.l - 1], ' ')
), n_hit AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (rid) LEFT JOIN found USING (rid)
""",
    # a body is longer than its text by its backslashes, its # before another # (all but one of each run) and its control marks
    "op5_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, len('### ' || role || ':' || chr(10) || '</turn>' || chr(10)) + len(text)
    + (len(text) - len(replace(text, '\', ''))) + (len(text) - len(replace(text, '#', ''))) - len(regexp_extract_all(text, '#+'))
    + (len(text) - len(replace(text, '</turn>', ''))) // 7 + (len(text) - len(replace(text, '<|', ''))) // 2 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM f GROUP BY conv_id
""",
}
