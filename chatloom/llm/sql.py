"""SQL of those queries that SQL can express, for the check against another engine."""


def _letters(x: str) -> str:
    return rf"regexp_replace(translate(replace(lower(coalesce({x}, '')), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]', '', 'g')"


_KEYS = rf"""
first_prompt AS (
    SELECT row_id, list_filter(flatten(list_filter(conversation, lambda t: t IS NOT NULL)), lambda m: lower(trim(m.role, E' \t\n\r')) = 'user')[1].content AS content
    FROM raw_corpus
), prompt_keys AS (
    SELECT 'raw_corpus' AS table_name, row_id AS id, {_letters("content")} AS k FROM first_prompt
), parsed AS (
    SELECT payload_id, TRY_CAST(payload AS JSON) AS j FROM raw_payloads
), held AS (
    SELECT payload_id, j, CASE WHEN json_type(json_extract(j, '$.conversation')) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.conversation') AS JSON) ELSE json_extract(j, '$.conversation') END AS c
    FROM parsed WHERE j IS NOT NULL
), said AS (
    SELECT payload_id, string_agg({_letters("json_extract_string(t.value, '$.role')")} || '/' || {_letters("json_extract_string(t.value, '$.content')")} || '/' || {_letters("json_extract_string(t.value, '$.language')")}, '|' ORDER BY t.id) AS k
    FROM held, json_tree(held.c) t WHERE t.type = 'OBJECT' GROUP BY payload_id
), payload_keys AS (
    SELECT 'raw_payloads' AS table_name, payload_id AS id,
        {_letters("json_extract_string(j, '$.conversation_id')")} || '#' || {_letters("json_extract_string(j, '$.model')")} || '#' || {_letters("json_extract_string(j, '$.turn')")} || '#' || coalesce(k, '') AS k
    FROM held LEFT JOIN said USING (payload_id) WHERE json_type(c) = 'ARRAY'
), keys AS (
    SELECT * FROM prompt_keys WHERE k <> '' UNION ALL SELECT * FROM payload_keys
), grouped AS (
    SELECT table_name, k, min(id) AS first_id, count(*) AS n_copies FROM keys GROUP BY table_name, k
)
"""

ORACLES = {
    "p1_prompt_groups": f"WITH {_KEYS} SELECT first_id, n_copies FROM grouped WHERE table_name = 'raw_corpus'",
    "p1_groups": f"WITH {_KEYS} SELECT table_name, first_id, n_copies FROM grouped",
    "p1_found": f"WITH {_KEYS} SELECT DISTINCT table_name, first_id, id AS copy_id FROM grouped JOIN keys USING (table_name, k) WHERE n_copies > 1 AND id <> first_id",
}
