"""SQL for DuckDB with the rows of the queries that SQL can express."""

from __future__ import annotations

from .secrets import RULES

_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
s AS (SELECT p.r, i, word, CASE WHEN i + 34 <= n THEN array_to_string(list_slice(w, i, i + 34), ' ') END AS phrase FROM p JOIN d USING (r)),
c AS (SELECT r, i, word, phrase IS NOT NULL AND count(*) OVER (PARTITION BY phrase) > 1 AS again FROM s),
g AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, COALESCE(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

_CONTROL = r"(\|(?:turn|says|end|im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|/?INST\]|/?SYS>>)"
_ESCAPED = lambda c: rf"regexp_replace({c}, '([<\[])(\\*)" + _CONTROL + rf"', '\1\\\2\3', 'g')"
_OP5 = rf"""
WITH a AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(8 + 8 + 7 + length({_ESCAPED("role")}) + length({_ESCAPED("text")})) AS chars FROM a GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM t"""


def _spans(place: int) -> str:
    """Starts and ends of a rule's matches: lengths of what stands between and of the matches, summed up to each."""
    rule = RULES[place]
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT r, {place} AS k, '{rule.kind}' AS kind, s AS a, s + m AS b FROM (
      SELECT r, unnest(v) AS v, unnest(ms) AS m, unnest(list_transform(ms, lambda x, i: list_sum(list_transform(list_slice(gs, 1, i), lambda y: length(y))) + COALESCE(list_sum(list_slice(ms, 1, i - 1)), 0))) AS s FROM (
        SELECT r, string_split_regex(text, '{pattern}') AS gs, list_transform(regexp_extract_all(text, '{pattern}', 0), lambda x: length(x)) AS ms, list_transform(regexp_extract_all(text, '{pattern}', {rule.group}), lambda x: length(x)) AS v FROM d WHERE regexp_matches(text, '{pattern}'))) WHERE v >= {rule.least}"""


_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_spans(i) for i in range(len(RULES)))}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (k = {i}) AS n_{x.kind}" for i, x in enumerate(RULES))}, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"CAST(COALESCE(n_{x.kind}, 0) AS BIGINT) AS n_{x.kind}" for x in RULES)}, sha256(COALESCE(spans, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""

ORACLE_SQL = {"op1_substring_dedup": _OP1, "op5_chat_formatting": _OP5, "op7_secret_scans": _OP7}
