"""Queries over created memories, devices, tasks, configurations and lists."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import administration as ops
from ..operators import entities, search
from ..sources import frames
from . import sql as S
from .registration import Registry

registry = Registry()
query = registry.query

_NOW = "timestamp_ntz'2024-02-01 00:00:00'"


@query("SELECT 'n' || item_id AS id, CASE item_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'conversation' ELSE 'manual' END AS source_type, CASE WHEN item_id % 2 = 0 THEN '[\"a\",\"b\"]' ELSE '[]' END AS metadata, CASE WHEN item_id % 4 = 0 THEN 'global' ELSE 'project' END AS scope, CASE WHEN item_id % 5 = 0 THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence, 'private' AS visibility, 'unknown' AS owner FROM benchmark")
def create_memory(spark: SparkSession, d: str) -> DataFrame:
    requests = frames.table(spark, d, "benchmark").selectExpr(
        "concat('n', item_id) AS id", "'t' AS title", "text AS content", "'semantic' AS memory_type", "case when item_id % 4 = 0 then 'global' end AS scope", "case when item_id % 5 = 0 then 0.3D end AS confidence",
        "cast(null AS string) AS visibility", "case when item_id % 2 = 0 then array('a', 'b') end AS tags", "case when item_id % 3 = 0 then 'codex' end AS source_type", "case when item_id % 3 < 2 then 'conversation' end AS source",
    )
    return ops.create_memories(requests, F.expr(_NOW)).select("id", "source_type", "metadata", "scope", "confidence", "visibility", "owner")


_CHANGES = """c AS (
  SELECT 'm' || user_id % 60 AS id, ts AS t0, event_id AS seq, CASE WHEN event_type = 'error' AND event_id % 8 = 0 THEN 'delete' ELSE 'set' END AS op,
    CASE event_type WHEN 'click' THEN ['title'] WHEN 'view' THEN ['status'] WHEN 'purchase' THEN ['title', 'status'] ELSE [] END AS given,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type || event_id END AS title, 's' || event_id % 5 AS status FROM events
), f AS (
  SELECT id, max({'at': t0, 'seq': seq}) FILTER (op = 'delete') AS gone, max({'at': t0, 'seq': seq}) FILTER (op = 'set' AND len(given) > 0) AS wrote, max({'at': t0, 'seq': seq}) FILTER (op = 'set') AS last_set, min(t0) FILTER (op = 'set') AS created_at,
    max({'at': t0, 'seq': seq, 'v': title}) FILTER (op = 'set' AND list_contains(given, 'title')) AS t, max({'at': t0, 'seq': seq, 'v': status}) FILTER (op = 'set' AND list_contains(given, 'status')) AS s FROM c GROUP BY id
)"""
_SINCE = "(gone IS NULL OR {'at': %s.at, 'seq': %s.seq} > gone)"


def _entity_changes(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "events").selectExpr(
        "concat('m', user_id % 60) AS id", "ts AS at", "event_id AS seq", "case when event_type = 'error' and event_id % 8 = 0 then 'delete' else 'set' end AS op",
        "case event_type when 'click' then array('title') when 'view' then array('status') when 'purchase' then array('title', 'status') else cast(array() AS array<string>) end AS given",
        "case when event_id % 3 = 0 then null else concat(event_type, event_id) end AS title", "concat('s', event_id % 5) AS status", "user_id",
    )


@query(S.with_(f"{S.MEMORIES}, {_CHANGES}", f"SELECT id, CASE WHEN t IS NOT NULL AND {_SINCE % ('t', 't')} THEN t.v WHEN gone IS NULL THEN title END AS title, CASE WHEN s IS NOT NULL AND {_SINCE % ('s', 's')} THEN s.v WHEN gone IS NULL THEN status END AS status, coalesce(wrote.at, updated_at) AS updated_at FROM memories LEFT JOIN f USING (id) WHERE gone IS NULL OR coalesce(wrote > gone, false)"))
def patch_memory(spark: SparkSession, d: str) -> DataFrame:
    """Many sparse changes per memory, in no order, explicit nulls and deletions among them."""
    return entities.patched(frames.memories(spark, d).select("id", "title", "status", "updated_at"), _entity_changes(spark, d), ["title", "status"])


@query(S.with_(_CHANGES, f"SELECT id, CASE WHEN {_SINCE % ('t', 't')} THEN t.v END AS title, CASE WHEN {_SINCE % ('s', 's')} THEN s.v END AS status, created_at, last_set.at AS updated_at, CASE WHEN NOT lives THEN gone.at END AS deleted_at, lives FROM (SELECT *, last_set IS NOT NULL AND (gone IS NULL OR last_set > gone) AS lives FROM f)"))
def entity_fold(spark: SparkSession, d: str) -> DataFrame:
    return entities.fold(_entity_changes(spark, d), ["title", "status"])


_TREE = """a AS (
  SELECT 'a' || user_id % 200 AS id, max({'at': ts, 'seq': event_id}) FILTER (event_type <> 'error') AS last_set, max({'at': ts, 'seq': event_id}) FILTER (event_type = 'error') AS gone, 'w' || any_value(user_id) % 40 AS workspace_id FROM events GROUP BY user_id % 200
), w AS (
  SELECT 'w' || event_id % 50 AS id, max({'at': ts, 'seq': event_id}) FILTER (event_type <> 'signup') AS last_set, max({'at': ts, 'seq': event_id}) FILTER (event_type = 'signup') AS gone FROM events GROUP BY event_id % 50
), ws AS (SELECT id, gone.at AS gone_at, coalesce(last_set > gone, gone IS NULL) AS lives FROM w), al AS (SELECT *, coalesce(last_set > gone, gone IS NULL) AS alive FROM a)"""


@query(f"WITH {_TREE} SELECT al.id, workspace_id, alive AND coalesce(ws.lives, true) AS lives, CASE WHEN NOT (alive AND coalesce(ws.lives, true)) THEN coalesce(CASE WHEN NOT alive THEN al.gone.at END, ws.gone_at) END AS deleted_at FROM al LEFT JOIN ws ON ws.id = workspace_id")
def workspace_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts go with their workspace."""
    events = frames.table(spark, d, "events")
    change = lambda key, deletes, more: events.selectExpr(f"{key} AS id", "ts AS at", "event_id AS seq", f"if(event_type = '{deletes}', 'delete', 'set') AS op", *more)
    workspaces = entities.fold(change("concat('w', event_id % 50)", "signup", ["array('name') AS given", "'n' AS name"]), ["name"])
    artifacts = entities.fold(change("concat('a', user_id % 200)", "error", ["array('workspace_id') AS given", "concat('w', user_id % 200 % 40) AS workspace_id"]), ["workspace_id"])
    home = events.selectExpr("concat('a', user_id % 200) AS id", "concat('w', user_id % 200 % 40) AS workspace_id").distinct()
    whole = artifacts.drop("workspace_id").join(home, "id")
    return entities.cascaded(whole, workspaces, "workspace_id").select("id", "workspace_id", "lives", "deleted_at")


@query(S.with_(f"{S.DOC}, {S.EXTS}", "SELECT 'ext' AS part, id, CAST(is_current AND coalesce(source_path NOT LIKE '/kb/src1/%', true) AS VARCHAR) AS state, NULL AS updated_at FROM knowledge_ext LEFT JOIN doc USING (id) UNION ALL SELECT 'doc', id, CASE WHEN starts_with(source_path, '/kb/src1/') THEN 'deleted' ELSE status END, CASE WHEN starts_with(source_path, '/kb/src1/') THEN TIMESTAMP '2024-02-01' ELSE updated_at END FROM doc"))
def delete_flips_current(spark: SparkSession, d: str) -> DataFrame:
    doc, ext = ops.delete(frames.doc(spark, d), frames.knowledge_ext(spark, d), F.col("source_path").startswith("/kb/src1/"), F.expr(_NOW))
    exts = ext.select(F.lit("ext").alias("part"), "id", F.col("is_current").cast("string").alias("state"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return exts.unionByName(doc.select(F.lit("doc").alias("part"), "id", F.col("status").alias("state"), "updated_at"))


@query(S.with_(f"{S.DOC}, {S.EXTS}", "SELECT 'doc' AS part, id FROM doc WHERE NOT coalesce(type = 'knowledge' AND (starts_with(source_path, '/kb/src0/') OR starts_with(source_path, '/kb/src2/')), false) UNION ALL SELECT 'ext', id FROM knowledge_ext WHERE id NOT IN (SELECT id FROM doc WHERE type = 'knowledge' AND (starts_with(source_path, '/kb/src0/') OR starts_with(source_path, '/kb/src2/')))"))
def delete_config_with_ext(spark: SparkSession, d: str) -> DataFrame:
    doc, ext = ops.delete_under(frames.doc(spark, d), frames.knowledge_ext(spark, d), ["/kb/src0/", "/kb/src2/"])
    return doc.select(F.lit("doc").alias("part"), "id").unionByName(ext.select(F.lit("ext").alias("part"), "id"))


def _cleared(spark: SparkSession, d: str, *categories: str) -> DataFrame:
    """table, id and metadata of all rows after a clearing."""
    tables = {"doc": frames.doc(spark, d), "memory_ext": frames.memory_ext(spark, d), "knowledge_ext": frames.knowledge_ext(spark, d)}
    after = tables | ops.clear(tables, set(categories), ops.CONFIRMED)
    rows = [t.select(F.lit(n).alias("part"), "id", (F.col("metadata") if n == "doc" else F.lit(None).cast("string")).alias("metadata")) for n, t in after.items()]
    return reduce(DataFrame.unionByName, rows)


@query(S.with_(f"{S.DOC}, {S.EXTS}", "SELECT 'doc' AS part, id, CASE WHEN type <> 'session' THEN metadata END AS metadata FROM doc WHERE type <> 'memory' UNION ALL SELECT 'knowledge_ext', id, NULL FROM knowledge_ext"))
def clear_category(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a type go with their extension table, another type only loses its metadata."""
    return _cleared(spark, d, "memory", "session_metadata")


_GONE = "(SELECT id FROM doc WHERE status = 'deleted')"


@query(S.with_(f"{S.DOC}, {S.EXTS}", f"SELECT 'doc' AS part, id, metadata FROM doc WHERE status <> 'deleted' UNION ALL SELECT 'memory_ext', id, NULL FROM memory_ext WHERE id NOT IN {_GONE} UNION ALL SELECT 'knowledge_ext', id, NULL FROM knowledge_ext WHERE id NOT IN {_GONE}"))
def clear_deleted(spark: SparkSession, d: str) -> DataFrame:
    """What was marked as deleted goes, with its rows in the extension tables; categories beside it count for nothing."""
    return _cleared(spark, d, "deleted", "memory")


_ACTION = "CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'revoke' ELSE 'heartbeat' END"


@query(f"WITH e AS (SELECT user_id AS id, ts, event_id, {_ACTION} AS action FROM events), f AS (SELECT id, min(CASE WHEN action = 'register' THEN ts END) AS first, arg_max(action, (ts, event_id)) AS last, max(CASE WHEN action = 'heartbeat' THEN ts END) AS seen FROM e GROUP BY id) SELECT id, CASE last WHEN 'register' THEN 'pending' WHEN 'approve' THEN 'approved' WHEN 'revoke' THEN 'revoked' ELSE CASE WHEN epoch(TIMESTAMP '2024-01-29 12:00:00' - seen) >= 301 THEN 'offline' ELSE 'online' END END AS status, CASE WHEN seen >= first THEN seen END AS last_seen FROM f WHERE first IS NOT NULL")
def device_fold(spark: SparkSession, d: str) -> DataFrame:
    events = frames.table(spark, d, "events").selectExpr("user_id AS id", "ts AS at", "event_id AS seq", f"{_ACTION} AS action")
    return ops.devices(events, F.expr("timestamp_ntz'2024-01-29 12:00:00'"))


@query(S.with_(S.MEMORIES, "SELECT id, (SELECT count(*) FROM memories WHERE status = 'active') AS total FROM memories WHERE status = 'active' ORDER BY updated_at DESC, id LIMIT 10 OFFSET 5"))
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.memories(spark, d).where("status = 'active'").select("id", "updated_at")
    return ops.page(rows, [F.desc("updated_at"), F.col("id")], 10, 5).select("id", "total")


@query(S.with_(S.FULL, "SELECT id, confidence FROM defaulted WHERE type = 'memory' AND status = 'active' ORDER BY confidence DESC, id LIMIT 10"))
def most_trusted(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_memory_defaults(frames.memories(spark, d).where("status = 'active'"), frames.memory_ext(spark, d))
    return ops.most_trusted(rows.select("id", "confidence"))


@query(S.with_(S.DOC, "SELECT id, updated_at FROM doc ORDER BY updated_at DESC, id LIMIT 50"))
def newest_rows(spark: SparkSession, d: str) -> DataFrame:
    return ops.newest(frames.doc(spark, d).select("id", "updated_at"), "updated_at")


@query(S.with_(S.FULL, "SELECT id FROM defaulted WHERE source_type NOT IN ('hermes_session', 'codex_session', 'gemini_session', 'openclaw_session') AND source_type = 'codex' AND memory_type = 'episodic'"))
def shown_memories(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_memory_defaults(frames.doc(spark, d), frames.memory_ext(spark, d))
    return ops.shown(rows, "codex", "episodic").select("id")


_TASKS = "CASE event_type WHEN 'signup' THEN 'indexing' WHEN 'click' THEN 'vectorizing_text' WHEN 'view' THEN 'vectorizing' ELSE 'other' END"


@query(f"SELECT count(*) AS total, count_if(t = 'indexing' AND NOT q) AS indexing, count_if(q) AS queued, count_if(starts_with(t, 'vectorizing')) AS vectorizing FROM (SELECT {_TASKS} AS t, event_id % 3 = 0 AS q FROM events)")
def task_counters(spark: SparkSession, d: str) -> DataFrame:
    return ops.task_counters(frames.table(spark, d, "events").selectExpr(f"{_TASKS} AS task_type", "event_id % 3 = 0 AS queued"))


@query("SELECT event_id AS id, ts AS ended_at FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 15")
def recent_tasks(spark: SparkSession, d: str) -> DataFrame:
    return ops.recent_tasks(frames.table(spark, d, "events").selectExpr("event_id AS id", "ts AS ended_at", "event_type <> 'view' AS completed")).select("id", "ended_at")


@query(S.with_(S.SCAN, "SELECT array_to_string(string_split(path, '/')[1:3], '/') AS folder, count(*) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM scan GROUP BY 1"))
def folder_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ops.folder_sizes(frames.second_scan(spark, d).select("path", F.octet_length("content").cast("long").alias("length")), 2)


@query(S.with_(S.SCAN, "SELECT path, sha256(content) AS hash, octet_length(encode(content)) AS bytes FROM scan"))
def index_state(spark: SparkSession, d: str) -> DataFrame:
    return ops.index_state(frames.second_scan(spark, d))


@query("SELECT event_id, CASE WHEN t > ts THEN t ELSE t + INTERVAL 1 DAY END AS next_run FROM (SELECT event_id, ts, date_trunc('day', ts) + to_minutes(CAST(event_id % 24 * 60 + event_id % 60 AS BIGINT)) AS t FROM events)")
def next_run(spark: SparkSession, d: str) -> DataFrame:
    at = F.format_string("%02d:%02d", F.col("event_id") % 24, F.col("event_id") % 60)
    return frames.table(spark, d, "events").select("event_id", ops.next_run(at, F.col("ts")).alias("next_run"))


@query("SELECT id, CAST(place AS INTEGER) AS place, CASE place WHEN 0 THEN '/a/' || id ELSE '/b/' || id END AS path FROM (SELECT item_id AS id, unnest(range(0, 2)) AS place FROM benchmark)")
def config_paths(spark: SparkSession, d: str) -> DataFrame:
    return ops.all_paths(frames.table(spark, d, "benchmark").selectExpr("item_id AS id", "array(concat('/a/', item_id), concat('/b/', item_id)) AS paths"))


@query("SELECT DISTINCT 'kind' || user_id % 5 AS agent_type, 'env' || user_id % 3 AS environment FROM events")
def distinct_agents(spark: SparkSession, d: str) -> DataFrame:
    probes = frames.table(spark, d, "events").selectExpr("concat('kind', user_id % 5) AS agent_type", "concat('env', user_id % 3) AS environment", "'' AS path", "true AS valid")
    return ops.installed_agents(probes).drop("path")


def _imported(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    rows = frames.table(spark, d, "benchmark").where("item_id % 2 = 0").selectExpr("concat(case when item_id % 4 = 0 then 'm' else 'y' end, item_id) AS id", "'new' AS title", "'more' AS content", "item_id AS place")
    return ops.import_rows(frames.memories(spark, d).select("id", "title", "content"), rows, strategy)


_OLD = "o AS (SELECT 'm' || item_id AS id, 'memory ' || item_id AS title, text AS content, item_id FROM benchmark), i AS (SELECT CASE WHEN item_id % 4 = 0 THEN 'm' ELSE 'y' END || item_id AS id, item_id FROM benchmark WHERE item_id % 2 = 0)"
_NEW = "SELECT id, 'new' AS title, 'more' AS content FROM i WHERE starts_with(id, 'y')"


@query(S.with_(_OLD, f"SELECT id, title, content FROM o UNION ALL {_NEW}"))
def import_skip(spark: SparkSession, d: str) -> DataFrame:
    return _imported(spark, d, "skip")


@query(S.with_(_OLD, f"SELECT id, CASE WHEN item_id % 4 = 0 THEN 'new' ELSE title END AS title, CASE WHEN item_id % 4 = 0 THEN 'more' ELSE content END AS content FROM o UNION ALL {_NEW}"))
def import_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return _imported(spark, d, "overwrite")


@query(S.with_(_OLD, f"SELECT id, title, CASE WHEN item_id % 4 = 0 THEN content || chr(10) || chr(10) || 'more' ELSE content END AS content FROM o UNION ALL {_NEW}"))
def import_append(spark: SparkSession, d: str) -> DataFrame:
    return _imported(spark, d, "merge")


@query(S.with_(_OLD, f"SELECT id, title, content FROM o UNION ALL SELECT id || '-v2', 'new', 'more' FROM i WHERE starts_with(id, 'm') UNION ALL {_NEW}"))
def import_version(spark: SparkSession, d: str) -> DataFrame:
    return _imported(spark, d, "version")


@query(S.with_(S.DOC, "SELECT round(100 * (count_if(status = 'active') / count(*) + count_if(coalesce(length(content), 0) > 0) / count(*) + count_if(coalesce(metadata, '') NOT IN ('', '{}', '[]')) / count(*)) / 3, 4) AS score, count(*) AS n FROM doc"))
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return ops.health_score(frames.doc(spark, d))
