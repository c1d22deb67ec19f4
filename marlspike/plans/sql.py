"""The derived tables of sources.frames, as common table expressions for DuckDB."""

KNOWLEDGE = """
knowledge AS (
  SELECT 'k' || doc_id AS id, 'knowledge' AS type, 'doc ' || doc_id AS title, text AS content, CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'archived' ELSE 'active' END AS status,
    'knowledge' AS source_type, '/kb/' || source || '/' || lang || '/' || doc_id || '.md' AS source_path,
    CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '{}' ELSE '["' || lang || '","' || source || '"]' END AS metadata, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at
  FROM documents
)"""
SESSIONS = """
session_text AS (
  SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id
), sessions AS (
  SELECT 's' || conv_id AS id, 'session' AS type, 'session ' || conv_id AS title, content, CASE WHEN conv_id % 10 = 0 THEN 'deleted' ELSE 'active' END AS status,
    ['hermes_session', 'codex_session', 'gemini_session', 'openclaw_session', 'openclaw'][conv_id % 5 + 1] AS source_type, '/sessions/' || conv_id || '.jsonl' AS source_path,
    CASE WHEN conv_id % 3 = 0 THEN '{}' ELSE '["chat"]' END AS metadata, TIMESTAMP '2024-01-15' + to_minutes(conv_id) AS updated_at
  FROM session_text
)"""
MEMORIES = """
memories AS (
  SELECT 'm' || item_id AS id, 'memory' AS type, 'memory ' || item_id AS title, text AS content, CASE WHEN item_id % 8 = 0 THEN 'deleted' ELSE 'active' END AS status,
    ['hermes', 'codex', 'gemini', 'openclaw', 'manual'][item_id % 5 + 1] AS source_type, CASE WHEN item_id % 3 = 0 THEN '' ELSE '/mem/' || item_id % 7 || '.md' END AS source_path,
    CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' ELSE '["note"]' END AS metadata, TIMESTAMP '2024-01-20' + to_minutes(item_id) AS updated_at
  FROM benchmark
)"""
EXTS = """
memory_ext AS (
  SELECT 'm' || item_id AS id, ['decision', 'episodic', 'semantic'][item_id % 3 + 1] AS memory_type, 'shared' AS scope, 'shared' AS visibility, [0.9, 0.4, 0.7][item_id % 3 + 1]::DOUBLE AS confidence
  FROM benchmark WHERE item_id % 4 <> 0
), knowledge_ext AS (
  SELECT 'k' || doc_id AS id, 1 + doc_id % 3 AS version, doc_id % 10 <> 0 AS is_current FROM documents WHERE doc_id % 7 <> 0
)"""
SCAN = """
scan AS (
  SELECT '/kb/' || source || '/' || lang || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 5 = 1 THEN text || ' v2' ELSE text END AS content FROM documents WHERE doc_id % 5 <> 0
  UNION ALL SELECT '/kb/new/' || doc_id || '.md', text FROM documents WHERE doc_id % 10 = 3
)"""
FILE_EVENTS = """
file_events AS (
  SELECT event_id, ts, user_id AS key, '/kb/src' || user_id % 20 || '/' || event_type || '.md' AS path, event_type,
    CASE event_type WHEN 'signup' THEN 'file_created' WHEN 'click' THEN 'file_modified' WHEN 'view' THEN 'file_modified' WHEN 'error' THEN 'file_deleted' END AS kind FROM events
)"""
DOC = f"{KNOWLEDGE}, {SESSIONS}, {MEMORIES}, doc AS (SELECT * FROM knowledge UNION ALL SELECT * FROM sessions UNION ALL SELECT * FROM memories)"
FULL = f"""{DOC}, {EXTS}, defaulted AS (
  SELECT doc.*, coalesce(memory_type, 'semantic') AS memory_type, coalesce(scope, 'project') AS scope, coalesce(visibility, 'private') AS visibility, coalesce(confidence, 0.8) AS confidence
  FROM doc LEFT JOIN memory_ext USING (id)
)"""
VECTORIZED = "coalesce(metadata NOT IN ('', '{}', '[]'), false)"


def fold(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def with_(tables: str, body: str) -> str:
    return f"WITH {tables}\n{body}"
