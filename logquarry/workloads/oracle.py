"""SQL with the same results as the registered queries, on the same tables."""

from __future__ import annotations

from .queries import INTERNAL, PUBLIC
from .views import FILE_DOCUMENTS, FILE_SPAN, MEMBERS

_SESSION = "'d' || day(ts) || '-' || (user_id % 5)"
_ISO = "'%Y-%m-%dT%H:%M:%S'"
_STAMP = "'%Y%m%dT%H%M%SZ'"

_LOG = f"""log AS (
  SELECT 'ev' || event_id AS event_id, event_type, ts AS "timestamp",
         'org' || (user_id % 4) || '/user' || user_id AS project_id,
         'model-' || (event_id % 3) AS model,
         'on-' || event_type AS name,
         'run' || event_id // 8 AS trace_id,
         {_SESSION} AS session_id,
         left(md5(props), 8) AS input_hash,
         CASE WHEN event_id % 17 = 0 THEN '{{broken' WHEN event_id % 19 = 0 THEN NULL ELSE props END AS body
  FROM events)"""

_VALID_BODY = "CASE WHEN json_valid(body) THEN body ELSE '{}' END AS body"


def _table_search(where: str, limit: int) -> str:
    return f"""WITH {_LOG}
SELECT event_id AS id, event_type AS type, "timestamp", {_VALID_BODY}
FROM log WHERE {where}
ORDER BY "timestamp" DESC, event_id LIMIT {limit}"""


_ORG1 = "starts_with(project_id, 'org1/')"

_KEYS = f"""keys AS (
  SELECT event_id, project_id || '/' || session_id || trace_part || '_' || trace_type || '_' || input_hash || '_'
           || CASE WHEN event_id % 13 = 0 THEN 'notatime' ELSE strftime(ts, {_STAMP}) END || '_n' || event_id
           || CASE WHEN event_id % 5 = 0 THEN '.json.jsonl' ELSE '.jsonl' END AS key, *
  FROM (
    SELECT *, 'org' || (user_id % 4) || '/user' || user_id AS project_id,
           {_SESSION} AS session_id,
           CASE WHEN event_id % 7 = 0 THEN '_run_of_' || event_id // 8
                WHEN event_id % 11 = 0 THEN '' ELSE '_run' || event_id // 8 END AS trace_part,
           'on-' || event_type AS trace_type, left(md5(props), 8) AS input_hash
    FROM events))"""

# Batch files: one per tenant and span of event ids, named after the first event in it.
_FILES = f"""files AS (
  SELECT *, project_id || '/' || session_id || trace_part || '_' || trace_type || '_' || input_hash || '_'
           || CASE WHEN member % 13 = 0 THEN 'notatime' ELSE strftime(first_ts, {_STAMP}) END
           || '_u' || span || '.jsonl' AS key,
         CASE WHEN trace_part = '' THEN 'unknown' ELSE substring(trace_part, 2) END AS trace_id,
         date_trunc('second', first_ts) AS file_ts,
         strftime(first_ts, {_ISO}) || '+00:00' AS "timestamp"
  FROM (
    SELECT *, 'org' || (member % 4) || '/user' || member AS project_id,
           's' || (member % 40) AS session_id,
           CASE WHEN member % 7 = 0 THEN '_run_of_' || member
                WHEN member % 11 = 0 THEN '' ELSE '_run' || member END AS trace_part,
           'kind' || (member % 3) AS trace_type, left(md5(CAST(member AS VARCHAR)), 8) AS input_hash
    FROM (SELECT user_id % {MEMBERS} AS member, event_id // {FILE_SPAN} AS span, min(ts) AS first_ts
          FROM events GROUP BY ALL)))"""

_LINES = f"""{_FILES},
lines AS (
  SELECT 'ev' || e.event_id AS id, e.event_type AS type,
         CASE WHEN e.event_id % 19 = 0 THEN NULL ELSE e.props END AS body,
         CASE WHEN e.event_id % 23 = 0 THEN 'm' END AS model, e.event_id, f.*
  FROM events e JOIN files f ON e.user_id % {MEMBERS} = f.member AND e.event_id // {FILE_SPAN} = f.span)"""

_READABLE = "member % 13 <> 0"
_FILE_COLUMNS = 'key, session_id, trace_id, trace_type, input_hash, "timestamp"'


def _file_search(where: str, limit: int, more: str = "") -> str:
    return f"""WITH {_LINES}
SELECT id, type, "timestamp", body, key{more} FROM lines
WHERE {_READABLE} AND {where}
ORDER BY file_ts DESC, key, id, body LIMIT {limit}"""


_TRACES = f"""traces AS (
  SELECT 'ev' || event_id AS id, 'trace' AS type, ts AS "timestamp",
         {_SESSION} AS session_id,
         CASE WHEN event_id % 23 <> 0 THEN 'on-' || event_type END AS name,
         '{{"input":' || props || ',"output":null,"metadata":{{"k":"' || event_type || '"}}}}' AS body,
         event_type AS tags, value AS latency, round(value / 100, 4) AS total_cost,
         'org' || (user_id % 4) || '/user' || user_id AS project_id
  FROM events)"""
_TRACE_ISO = """CASE WHEN microsecond("timestamp") % 1000000 = 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S')
            ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS "timestamp\""""
_TRACE_COLUMNS = 'id, type, "timestamp", session_id, name, body, tags, latency, total_cost'

_SAID = """said AS (
  SELECT conv_id, turn, said.role AS role,
         CASE WHEN conv_id % 3 = 1 THEN said.text || ' !' ELSE said.text END AS content
  FROM (SELECT conv_id, turn, min({'role': role, 'text': text}) AS said FROM conversations GROUP BY conv_id, turn)
  WHERE (conv_id + turn) % 5 <> 0 AND said.text <> '' AND said.role <> '')"""
_CONVERSATION = """count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,
       md5(string_agg(content, '|' ORDER BY turn)) AS contents"""

_MESSAGE = "struct<content:variant,role:string>"
# Messages as VARIANT prints them, with sorted keys; the last turn is the answer.
_SAID_ALL = """turns AS (
  SELECT conv_id, turn, said.role AS role, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE said.text END AS spoken
  FROM (SELECT conv_id, turn, min({'role': role, 'text': text}) AS said FROM conversations GROUP BY conv_id, turn)
), messages AS (
  SELECT conv_id, turn, '{"content":' || CASE WHEN conv_id % 3 = 1 AND spoken <> ''
           THEN '[{"text":' || to_json(spoken) || ',"type":"text"},{"content":"!","type":"note"}]' ELSE to_json(spoken) END
         || ',"role":' || to_json(role) || '}' AS message, max(turn) OVER (PARTITION BY conv_id) AS final
  FROM turns
), asked AS (
  SELECT conv_id, coalesce(string_agg(message, ',' ORDER BY turn) FILTER (WHERE turn <> final), '') AS asked
  FROM messages GROUP BY conv_id)"""

_MEDIA = f"""media AS (
  SELECT *, project_id || '/media/' || media_id || '.bin' AS blob_key
  FROM (
    SELECT 'org' || (member % 4) || '/user' || member AS project_id, 'm' || member || '-' || span AS media_id,
           'image/png' AS content_type, count(*) AS content_length,
           CASE WHEN member % 3 <> 0 THEN
             CASE WHEN microsecond(min(ts)) % 1000000 = 0 THEN strftime(min(ts), '%Y-%m-%dT%H:%M:%S')
                  ELSE strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' END AS uploaded_at,
           bool_or(event_type = 'purchase') AS bought
    FROM (SELECT *, user_id % {MEMBERS} AS member, event_id // {FILE_SPAN} AS span FROM events)
    GROUP BY member, span))"""
_MEDIA_COLUMNS = "project_id, media_id, blob_key, content_type, content_length, uploaded_at"

# A document's body as the event derived from it holds it, for text searches.
_DOCUMENT_BODY = """'{"model":' || to_json(lang) || ',"input":' || CASE doc_id % 4
         WHEN 0 THEN to_json(text)
         WHEN 1 THEN '{"messages":[{"role":"system","content":"be brief"},{"role":"user","content":' || to_json(text) || '}]}'
         WHEN 2 THEN '[{"role":"user","content":[{"type":"text","text":' || to_json(text) || '},{"content":"end"},{"z":1,"a":2}]}]'
         ELSE '{"prompt":' || to_json(text) || ',"b":[1,2]}' END || ',"output":' || CASE doc_id % 3
         WHEN 0 THEN '{"choices":[{"message":{"content":' || to_json(source) || '}}]}'
         WHEN 1 THEN '{"content":' || to_json(source) || '}' ELSE 'null' END || '}'"""
_DOCUMENTS = f"""docs AS (
  SELECT doc_id, 'doc-' || doc_id AS id, lang AS type, text, source, {_DOCUMENT_BODY} AS body FROM documents)"""

_DOCUMENT_LINES = f"""{_DOCUMENTS},
document_lines AS (
  SELECT *, 'org' || g % 4 AS org, 'org' || g % 4 || '/user' || g % 52 || '/s' || g % 7 || '_run' || g || '_doc_d' || g % 16 || '_'
            || strftime(file_ts, {_STAMP}) || '_u' || g || '.jsonl' AS key, strftime(file_ts, {_ISO}) || '+00:00' AS "timestamp"
  FROM (SELECT *, doc_id // {FILE_DOCUMENTS} AS g, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id // {FILE_DOCUMENTS}) AS file_ts
        FROM docs))"""

ORACLE: dict[str, str] = {
    "search_table_org_ilike": _table_search(
        f"""{_ORG1} AND "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-20 07:00:00'
  AND body ILIKE '%"K": 7%'""",
        500,
    ),
    "search_table_user_like": _table_search("project_id = 'org1/user5' AND body LIKE '%\"k\"%'", 50),
    "search_table_wildcard": _table_search(f"{_ORG1} AND body ILIKE '%K_: %5%'", 500),
    "text_backslash": f"WITH {_DOCUMENTS} SELECT id, type FROM docs WHERE body ILIKE '%AN.\\n_h%'",
    "search_table_ids": _table_search(f"{_ORG1} AND session_id = 'd9-0' AND name = 'on-view'", 500),
    "search_table_trace": _table_search(f"{_ORG1} AND trace_id = 'run11'", 500),
    "events_by_hash": f"""WITH {_LOG} SELECT event_id, project_id, input_hash FROM log
WHERE input_hash = left(md5('{{"k": 7}}'), 8)""",
    "recent": _table_search(_ORG1, 100),
    "preset_window": _table_search(
        f"""{_ORG1} AND "timestamp" >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND "timestamp" <= TIMESTAMP '2024-01-20'""",
        500,
    ),
    "tenant_events": f"""WITH {_LOG}
SELECT event_id, event_type, "timestamp", project_id, model, name, trace_id, session_id, body
FROM log WHERE starts_with(project_id, 'org2/')""",
    "time_range_events": f"""WITH {_LOG}
SELECT event_id, "timestamp", input_hash FROM log
WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12' AND name = 'on-signup'""",
    "body_fallback": f"WITH {_LOG} SELECT event_id, {_VALID_BODY} FROM log",
    "text_literal": f"WITH {_DOCUMENTS} SELECT id, type FROM docs WHERE contains(lower(body), 'ou%%%') OR contains(lower(type), 'ou%%%')",
    "text_any_column": f"""WITH {_DOCUMENTS} SELECT id, type FROM docs
WHERE body ILIKE '%thand%ble%' OR id ILIKE '%thand%ble%' OR type ILIKE '%thand%ble%'""",
    "count_results": f"WITH {_DOCUMENTS} SELECT count(*) AS results FROM docs WHERE contains(body, 'hation')",
    "parse_keys": f"""WITH {_KEYS}
SELECT key, session_id, CASE WHEN trace_part = '' THEN 'unknown' ELSE substring(trace_part, 2) END AS trace_id,
       trace_type, input_hash, strftime(ts, {_ISO}) || '+00:00' AS "timestamp"
FROM keys WHERE event_id % 13 <> 0""",
    "owned_keys": f"WITH {_KEYS} SELECT key FROM keys WHERE starts_with(key, 'org1/')",
    "sanitize_keys": """SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(
         replace(trim(text), '..', ''), '[^a-zA-Z0-9_\\-./]', '_', 'g'), '/+', '/', 'g'), '/._-'), '') AS tenant_key
FROM documents""",
    "list_objects": f"""WITH {_FILES}, {_MEDIA}
SELECT key FROM files UNION ALL SELECT blob_key FROM media
UNION ALL SELECT replace(blob_key, '.bin', '.meta.json') FROM media""",
    "list_files": f"WITH {_FILES} SELECT {_FILE_COLUMNS} FROM files WHERE {_READABLE} AND {_ORG1}",
    "list_files_range": f"""WITH {_FILES} SELECT {_FILE_COLUMNS} FROM files
WHERE {_READABLE} AND {_ORG1} AND trace_type = 'kind2'
  AND file_ts BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 18:00:00'""",
    "list_files_ids": f"""WITH {_FILES} SELECT {_FILE_COLUMNS} FROM files
WHERE {_READABLE} AND {_ORG1} AND session_id = 's33' AND trace_id = 'unknown'""",
    "scan_statistics": f"""WITH {_FILES} SELECT count(*) AS files_scanned FROM files
WHERE {_READABLE} AND {_ORG1} AND file_ts >= TIMESTAMP '2024-01-01 02:00:00'""",
    "read_all_events": f"WITH {_LINES} SELECT id, type, body, model, key FROM lines WHERE {_READABLE}",
    "count_broken_lines": f"""WITH {_LINES} SELECT key, count(*) AS broken FROM lines
WHERE event_id % 97 = 0 AND {_READABLE} GROUP BY key""",
    "search_files": _file_search(
        f"""{_ORG1} AND file_ts BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-02 12:00:00'
  AND (body ILIKE '%PURCH%' OR id ILIKE '%PURCH%' OR type ILIKE '%PURCH%')""",
        500,
    ),
    "search_files_body": _file_search(
        """project_id = 'org1/user5' AND (body ILIKE '%"k": 7%' OR id ILIKE '%"k": 7%' OR type ILIKE '%"k": 7%')""", 100
    ),
    "search_files_all": _file_search(f"{_ORG1} AND session_id = 's5'", 500),
    "search_files_extra_fields": _file_search(
        f"{_ORG1} AND (body ILIKE '%ev4_%' OR id ILIKE '%ev4_%' OR type ILIKE '%ev4_%')",
        500,
        ", model",
    ),
    "search_traces": f"""WITH {_TRACES} SELECT {_TRACE_COLUMNS} FROM traces
WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'
  AND contains(lower(body || coalesce(name, '')), 'on-sig')
ORDER BY "timestamp" DESC, id LIMIT 500""",
    "search_traces_prelimit": f"""WITH {_TRACES}, fetched AS (
  SELECT * FROM traces WHERE session_id = 'd3-3' ORDER BY "timestamp" DESC, id LIMIT 100)
SELECT {_TRACE_COLUMNS} FROM fetched
WHERE name = 'on-signup' AND contains(lower(body || coalesce(name, '')), '"k": 4')""",
    "search_one_trace": f"WITH {_TRACES} SELECT {_TRACE_COLUMNS} FROM traces WHERE id = 'ev42'",
    "trace_mapping": f"""WITH {_TRACES}
SELECT id, type, id AS trace_id, session_id, name, body, tags AS tag, latency, total_cost FROM traces""",
    "landed_traces": f"""WITH {_TRACES}
SELECT id, {_TRACE_ISO},
       name, replace(body, '": ', '":') AS body, total_cost FROM traces""",
    "chat_dataset": f"""WITH {_SAID}
SELECT conv_id, {_CONVERSATION} FROM said GROUP BY conv_id HAVING count(*) >= 2""",
    "chat_dataset_files": f"""WITH {_SAID}
SELECT CAST(conv_id AS VARCHAR) AS id, {_CONVERSATION} FROM said
WHERE conv_id % 4 = 1 GROUP BY conv_id HAVING count(*) >= 2""",
    "preview_events": f"""WITH {_DOCUMENTS}
SELECT id, type, type AS model,
       CASE WHEN text = '' AND doc_id % 4 = 0 THEN '-' ELSE substring(CASE doc_id % 4
         WHEN 0 THEN text WHEN 1 THEN text
         WHEN 2 THEN CASE WHEN text = '' THEN '{{"type":"text","text":""}}' ELSE text END || ' end {{"z":1,"a":2}}'
         ELSE '{{"prompt":' || to_json(text) || ',"b":[1,2]}}' END, 1, 80) END AS input_preview,
       CASE WHEN doc_id % 3 = 2 THEN '-' ELSE substring(source, 1, 80) END AS output_preview
FROM docs""",
    "selected_events": f"""WITH {_LOG}
SELECT event_id, event_type, "timestamp", project_id FROM log l
WHERE EXISTS (SELECT 1 FROM log c WHERE c.event_id = l.event_id AND c.name = 'on-error' AND c.model = 'model-1')""",
    "selected_files": f"""WITH {_LINES} SELECT id, type, body, key FROM lines l
WHERE EXISTS (SELECT 1 FROM files f WHERE f.key = l.key AND {_READABLE} AND {_ORG1} AND f.trace_type = 'kind1')""",
    "manifest_uris": f"""WITH {_KEYS}
SELECT key, '{PUBLIC}/logs/{INTERNAL}/' || key AS url FROM keys WHERE starts_with(key, 'org1/')""",
    "manifest_files": f"""WITH {_FILES}
SELECT {_FILE_COLUMNS}, '{PUBLIC}/logs/' || key AS url, '2024-01-20T01:00:00+00:00' AS url_expiry FROM files
WHERE {_READABLE} AND {_ORG1} AND file_ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-03'""",
    "media_metadata": f"WITH {_MEDIA} SELECT {_MEDIA_COLUMNS} FROM media",
    "media_lookup": f"""WITH {_MEDIA}
SELECT {_MEDIA_COLUMNS}, '{PUBLIC}/logs/' || blob_key AS url, '2024-01-20T00:01:30+00:00' AS url_expiry
FROM media WHERE bought""",
    "export_jsonl_roundtrip": f"""WITH {_LOG}
SELECT event_id AS id, event_type AS type, "timestamp",
       CASE WHEN json_valid(body) THEN CAST(json(body) AS VARCHAR) ELSE '{{}}' END AS body FROM log""",
    "export_catalog_roundtrip": f"""WITH {_LINES}
SELECT id, type, CAST(json(body) AS VARCHAR) AS body, model FROM lines WHERE {_READABLE}""",
    "export_index_roundtrip": f"WITH {_KEYS} SELECT key, 's3a://logs/' || key AS url FROM keys",
    "export_url_index_roundtrip": f"""WITH {_FILES}
SELECT 's3a://logs/' || key AS url FROM files WHERE {_READABLE} AND {_ORG1}""",
    "export_dataset_roundtrip": f"""WITH {_SAID}
SELECT {_CONVERSATION} FROM said GROUP BY conv_id HAVING count(*) >= 2""",
    "search_partitioned_table": _table_search(
        f"""{_ORG1} AND "timestamp" >= TIMESTAMP '2024-01-11 18:00:00' AND "timestamp" <= TIMESTAMP '2024-01-14'
  AND body ILIKE '%"k": 1%'""",
        500,
    ),
    "search_source_table": _table_search(f"""{_ORG1} AND body LIKE '%{{"k": 2%%'""", 500),
    "millisecond_times": """SELECT 'ev' || event_id AS event_id,
       CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS "timestamp",
       CASE WHEN millisecond(ts) % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS milliseconds
FROM events""",
    "search_source_files": _file_search(
        "starts_with(project_id, 'org3/') AND (body ILIKE '%err_r%' OR id ILIKE '%err_r%' OR type ILIKE '%err_r%')", 500
    ),
    "strict_events": """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id,
       'org' || conv_id % 4 || '/user' || conv_id % 20 || '/s' || conv_id % 20 || '_run'
         || conv_id % 20 || '_chat_c' || conv_id % 20 || '_20240101T000000Z_u' || conv_id // 10000 || '.jsonl' AS key
FROM conversations""",
    "search_source_traces": f"""WITH {_TRACES}
SELECT id, {_TRACE_ISO}, name, replace(body, '": ', '":') AS body
FROM (SELECT * FROM traces WHERE starts_with(project_id, 'org1/') AND contains(lower(body || coalesce(name, '')), 'signup')
      ORDER BY traces."timestamp" DESC, id LIMIT 500)""",
    "media_of_source": f"""WITH {_MEDIA}
SELECT {_MEDIA_COLUMNS}, '{PUBLIC}/logs/' || blob_key AS url, '2024-01-20T00:01:30+00:00' AS url_expiry
FROM media WHERE project_id = 'org1/user5' AND media_id = 'm5-0'""",
    "located_source_files": f"""WITH {_FILES} SELECT key, 's3a://logs/' || key AS url FROM files
WHERE {_READABLE} AND project_id = 'org1/user9' AND file_ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'""",
    "search_table_all_matches": f"""WITH {_LOG}
SELECT event_id AS id, event_type AS type, "timestamp", {_VALID_BODY} FROM log
WHERE {_ORG1} AND body ILIKE '%"k"%'""",
    "search_catalog_table": _table_search(
        f"{_ORG1} AND \"timestamp\" >= TIMESTAMP '2024-01-11' AND \"timestamp\" <= TIMESTAMP '2024-01-12' AND body ILIKE '%\"k\": 2%'", 100
    ),
    "selected_events_large": f"""WITH {_LOG}
SELECT event_id, event_type, "timestamp", project_id FROM log WHERE event_type <> 'view'""",
    "selected_files_large": f"""WITH {_LINES} SELECT id, type, body, key FROM lines WHERE {_READABLE} AND {_ORG1} AND trace_type <> 'kind1'""",
    "search_files_own_fields": f"""WITH {_LINES}
SELECT id, type, "timestamp", body, key, own_trace AS trace_id, own_time AS event_timestamp
FROM (SELECT *, 'own' || (event_id % 10) AS own_trace, CAST(event_id % 60 AS VARCHAR) AS own_time FROM lines)
WHERE {_READABLE} AND {_ORG1} AND body ILIKE '%"k": 3%'""",
    "search_files_any": f"""WITH {_LINES} SELECT least(40, count(*)) AS results FROM lines
WHERE {_READABLE} AND {_ORG1} AND (body ILIKE '%"k"%' OR id ILIKE '%"k"%' OR type ILIKE '%"k"%')""",
    "list_files_inventory": f"""WITH {_FILES} SELECT {_FILE_COLUMNS} FROM files
WHERE {_READABLE} AND {_ORG1} AND trace_type = 'kind0'""",
    "list_files_no_tenant": f"WITH {_FILES} SELECT {_FILE_COLUMNS} FROM files WHERE project_id = 'nobody/here'",
    "search_source_traces_untagged": f"""WITH {_TRACES}
SELECT id, {_TRACE_ISO}, name, replace(body, '": ', '":') AS body
FROM (SELECT * FROM traces WHERE contains(lower(body || coalesce(name, '')), 'signup')
      ORDER BY traces."timestamp" DESC, id LIMIT 500)""",
    "trace_defaults": f"""WITH {_TRACES}
SELECT id, '' AS session_id, name, body, CAST(0 AS BIGINT) AS n_tags, CAST(NULL AS DOUBLE) AS latency FROM traces""",
    "export_traces_roundtrip": f"""WITH {_TRACES}
SELECT '{{"id":' || to_json(id) || ',"name":' || coalesce(to_json(name), 'null') || ',"output":null,"session_id":'
       || to_json(session_id) || ',"usage":null}}' AS line FROM traces""",
    "inventory_objects": f"""WITH {_FILES}, {_MEDIA}
SELECT key, split_part(key, '/', 1) AS org, CASE WHEN {_READABLE} THEN strftime(file_ts, '%Y-%m-%d') END AS day FROM files
UNION ALL SELECT unnest([blob_key, replace(blob_key, '.bin', '.meta.json')]), split_part(blob_key, '/', 1), NULL FROM media""",
    "search_files_inventory": _file_search(
        f"""{_ORG1} AND file_ts >= TIMESTAMP '2024-01-01 02:00:00'
  AND (body ILIKE '%"k": 7%' OR id ILIKE '%"k": 7%' OR type ILIKE '%"k": 7%')""",
        500,
    ),
    "search_files_inventory_all": f"""WITH {_LINES}
SELECT id, type, "timestamp", body, key, model FROM lines
WHERE {_READABLE} AND {_ORG1} AND trace_type = 'kind2' AND (body ILIKE '%PURCH%' OR id ILIKE '%PURCH%' OR type ILIKE '%PURCH%')""",
    "search_files_statistics": f"""WITH {_LINES}
SELECT id, key, (SELECT count(*) FROM files WHERE {_READABLE} AND {_ORG1} AND trace_type = 'kind1') AS files_scanned FROM lines
WHERE {_READABLE} AND {_ORG1} AND trace_type = 'kind1' AND (body ILIKE '%signup%' OR id ILIKE '%signup%' OR type ILIKE '%signup%')
ORDER BY file_ts DESC, key, id, body LIMIT 200""",
    "search_files_keys": f"""WITH {_FILES} SELECT {_FILE_COLUMNS} FROM files
WHERE {_READABLE} AND {_ORG1} AND trace_type = 'kind1'""",
    "search_files_skipping": f"""WITH {_DOCUMENT_LINES}
SELECT id, type, "timestamp", body, key FROM document_lines
WHERE org = 'org1' AND (body ILIKE '%ershsh%' OR id ILIKE '%ershsh%' OR type ILIKE '%ershsh%')""",
    "search_files_skipping_wildcard": f"""WITH {_DOCUMENT_LINES}
SELECT id, type, "timestamp", body, key FROM document_lines
WHERE org = 'org2' AND file_ts >= TIMESTAMP '2024-01-01 00:03:00' AND body ILIKE '%hanti%_ha%nd%'""",
    "read_chosen_files": f"""WITH {_LINES} SELECT id, type, body, key FROM lines
WHERE {_READABLE} AND {_ORG1} AND trace_type = 'kind0'""",
    "search_table_trace_lookup": _table_search(f"{_ORG1} AND trace_id = 'run9'", 500),
    "search_compacted_files": _file_search(
        f"""{_ORG1} AND file_ts BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-02 12:00:00'
  AND (body ILIKE '%PURCH%' OR id ILIKE '%PURCH%' OR type ILIKE '%PURCH%')""",
        500,
        ", model",
    ),
    "read_compacted_events": f"WITH {_LINES} SELECT id, type, body, model, key FROM lines WHERE {_READABLE}",
    "count_compacted_broken_lines": f"""WITH {_LINES} SELECT key, count(*) AS broken FROM lines
WHERE event_id % 97 = 0 AND {_READABLE} GROUP BY key""",
    "search_typed_records": f"""WITH {_LINES}
SELECT id, type, replace(body, ' ', '') AS body, model, 'own' || (event_id % 10) AS trace_id, CAST(event_id % 60 AS VARCHAR) AS "timestamp",
       key AS file_key, lines."timestamp" AS file_timestamp
FROM lines WHERE {_READABLE} AND {_ORG1} AND replace(body, ' ', '') LIKE '%"k":7%'""",
    "typed_chat_records": f"""WITH {_SAID_ALL}
SELECT CAST(conv_id AS VARCHAR) AS id,
       'struct<body:struct<input:struct<messages:array<{_MESSAGE}>>,output:struct<choices:array<struct<message:{_MESSAGE}>>>>,'
         || 'id:string,input:array<{_MESSAGE}>,output:{_MESSAGE}>' AS types,
       md5(CASE WHEN conv_id % 2 = 0 THEN '{{"messages":[' || asked || ']}}' ELSE '[' || asked || ']' END) AS input
FROM asked""",
    "media_lookup_table": f"""WITH {_MEDIA}
SELECT {_MEDIA_COLUMNS}, '{PUBLIC}/logs/' || blob_key AS url, '2024-01-20T00:01:30+00:00' AS url_expiry
FROM media WHERE bought""",
    "search_one_trace_stored": f"WITH {_TRACES} SELECT {_TRACE_COLUMNS} FROM traces WHERE id = 'ev42'",
}
