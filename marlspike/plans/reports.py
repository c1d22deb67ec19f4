"""Queries over totals, progress, schedules, devices and activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import administration, exchange, search, stats
from ..sources import frames
from . import sql as S
from .registration import Registry

registry = Registry()
query = registry.query

VEC = S.VECTORIZED


@query(S.with_(S.DOC, f"SELECT CASE WHEN grouping(source_type) = 1 THEN 'all' ELSE source_type END AS source_type, count(*) AS total, count(*) FILTER ({VEC}) AS embedded FROM doc WHERE type = 'memory' AND status = 'active' GROUP BY ROLLUP (source_type)"))
def memory_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.totals_by_source(frames.doc(spark, d), "memory")


_COUNTS = f"n AS (SELECT (SELECT count(*) FROM knowledge_ext WHERE is_current) AS t, count(*) FILTER (type = 'knowledge' AND status = 'active') AS i, count(*) FILTER (type = 'knowledge' AND status = 'active' AND {VEC}) AS v, max(updated_at) FILTER (type = 'knowledge') AS last_indexed FROM doc)"
_SHARE = "CASE WHEN {w} > 0 THEN round(least(100.0::DOUBLE, {p} / {w} * 100), 2) ELSE 0 END"
_STAGES = {"indexing": (400, 100, 5), "vectorizing_memory": (300, 7, 200), "pulling": (50, 20, 10), None: (0, 0, 0)}


def _stage_sql(stage: str | None, total: int, indexed: int, vectorized: int) -> str:
    plain = {"s": "'idle'", "total": "t", "i": "i", "v": "v", "ip": _SHARE.format(p="i", w="t"), "vp": _SHARE.format(p="v", w="t")}
    if stage == "indexing":
        plain |= {"s": "'indexing'", "total": str(total), "i": str(indexed), "ip": _SHARE.format(p=f"{indexed}.0::DOUBLE", w=total)}
    elif stage == "vectorizing_memory":
        plain |= {"s": "'vectorizing'", "vp": _SHARE.format(p=f"{vectorized}.0::DOUBLE", w=total)}
    elif stage:
        plain |= {"s": f"'{stage}'", "total": str(total), "i": str(indexed), "v": str(vectorized)}
    return "SELECT {s} AS stage, CAST({total} AS BIGINT) AS total_files, CAST({i} AS BIGINT) AS indexed_count, CAST({v} AS BIGINT) AS vectorized_count, CAST({ip} AS DOUBLE) AS index_progress, CAST({vp} AS DOUBLE) AS vectorize_progress, last_indexed FROM n".format(**plain)


@query(S.with_(f"{S.DOC}, {S.EXTS}, {_COUNTS}", " UNION ALL ".join(_stage_sql(stage, *numbers) for stage, numbers in _STAGES.items())))
def task_progress(spark: SparkSession, d: str) -> DataFrame:
    """What is shown while files are indexed, rows vectorized, something else runs, or nothing does."""
    doc, ext = frames.doc(spark, d), frames.knowledge_ext(spark, d)
    task = lambda stage, numbers: spark.createDataFrame([(stage, *numbers)] if stage else [], "stage string, total long, indexed long, vectorized long")
    first, *others = (stats.task_progress(doc, ext, task(stage, numbers)) for stage, numbers in _STAGES.items())
    for other in others:
        first = first.unionByName(other)
    return first


@query(S.with_(S.DOC, "SELECT source_type, count(*) AS n, min(updated_at) AS oldest, max(updated_at) AS newest FROM doc GROUP BY source_type"))
def group_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.grouped(frames.doc(spark, d), "source_type")


@query(S.with_(S.DOC, "SELECT id, CASE WHEN regexp_replace(source_type, '_session$', '') IN ('hermes', 'codex', 'gemini', 'openclaw', 'agent') THEN 'agent' ELSE 'other' END AS category, CASE WHEN type = 'knowledge' THEN 'knowledge' ELSE source_type END AS legacy FROM doc"))
def source_category(spark: SparkSession, d: str) -> DataFrame:
    source = F.col("source_type")
    return frames.doc(spark, d).select("id", parse.source_category(source).alias("category"), parse.legacy_source(F.col("type"), source).alias("legacy"))


_TIME = "lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')"


@query(f"SELECT event_id, strftime(t, '%H:%M') = {_TIME} AND event_id % 3 <> 0 AS due FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) + to_minutes(CAST(event_id % 24 * 60 + event_id % 60 AS BIGINT)) ELSE ts END AS t FROM events)")
def due_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose minute it is, unless they have run today already."""
    at = F.format_string("%02d:%02d", F.col("event_id") % 24, F.col("event_id") % 60)
    rows = frames.table(spark, d, "events").withColumn("now", F.expr("case when event_id % 2 = 0 then timestampadd(MINUTE, cast(event_id % 24 * 60 + event_id % 60 AS int), cast(date_trunc('day', ts) AS timestamp_ntz)) else ts end"))
    last = F.expr("case when event_id % 3 = 0 then now when event_id % 3 = 1 then now - INTERVAL 1 DAY end")
    return rows.select("event_id", administration.due(at, F.col("now"), last).alias("due"))


@query("SELECT DISTINCT user_id, sha256('device' || user_id || ':' || CASE WHEN user_id % 2 = 0 THEN 'linux' ELSE 'windows' END) AS fingerprint FROM events")
def device_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    users = frames.table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", parse.fingerprint(F.expr("concat('device', user_id)"), F.expr("case when user_id % 2 = 0 then 'linux' else 'windows' end")).alias("fingerprint"))


@query("SELECT key, event_id, event_type FROM (SELECT user_id % 20 AS key, event_id, event_type, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def hub_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of what was found under one key the first stays."""
    rows = frames.table(spark, d, "events").selectExpr("user_id % 20 AS key", "ts", "event_id", "event_type")
    return administration.first_by(rows, ["key"], ["ts", "event_id"]).drop("ts")


@query("SELECT agent_type, environment, path FROM (SELECT 'kind' || user_id % 5 AS agent_type, 'env' || user_id % 3 AS environment, '/home/' || user_id || '/' || event_type AS path, row_number() OVER (PARTITION BY user_id % 5, user_id % 3 ORDER BY '/home/' || user_id || '/' || event_type) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def installed_agents(spark: SparkSession, d: str) -> DataFrame:
    probes = frames.table(spark, d, "events").selectExpr("concat('kind', user_id % 5) AS agent_type", "concat('env', user_id % 3) AS environment", "concat('/home/', user_id, '/', event_type) AS path", "event_type <> 'error' AS valid")
    return administration.installed_agents(probes)


_PENDING = f"status = 'active' AND NOT {VEC}"


@query(S.with_(f"{S.DOC}, {S.EXTS}", f"SELECT 'knowledge' AS kind, id FROM doc WHERE {_PENDING} AND type = 'knowledge' AND id NOT IN (SELECT id FROM knowledge_ext WHERE NOT is_current) UNION ALL SELECT 'session', id FROM doc WHERE {_PENDING} AND type = 'session' UNION ALL SELECT 'codex', id FROM doc WHERE {_PENDING} AND source_type = 'codex' UNION ALL SELECT 'all', id FROM doc WHERE {_PENDING}"))
def pending_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """What a job for a type, for one source, or for everything has to do."""
    doc, ext = frames.doc(spark, d), frames.knowledge_ext(spark, d)
    first, *others = (search.pending(doc, ext, kind).select(F.lit(kind or "all").alias("kind"), "id") for kind in ("knowledge", "session", "codex", None))
    for other in others:
        first = first.unionByName(other)
    return first


_KINDS = "['agent', 'decision', 'git', 'browser', 'chat', 'preference'][event_id % 6 + 1]"
_ROWS = f"a AS (SELECT event_id, {_KINDS} AS kind, CASE WHEN event_id % 5 = 0 THEN 'line one' || chr(10) || 'line two' ELSE 'title ' || event_id END AS title, 'body ' || event_id AS content, CASE WHEN event_id % 12 = 4 THEN 'wechat' ELSE 'd' || event_id % 7 END AS detail, 'u' || user_id AS actor FROM events)"
_NL = "chr(10)"


@query(S.with_(_ROWS, f"""
SELECT event_id, CASE kind WHEN 'git' THEN 'Git: ' || split_part(title, {_NL}, 1) WHEN 'browser' THEN '浏览: ' || title WHEN 'chat' THEN detail || ': ' || title WHEN 'preference' THEN '偏好: ' || title ELSE title END AS title,
  CASE kind WHEN 'decision' THEN '# ' || title || {_NL} || {_NL} || content || {_NL} || {_NL} || '## 决策原因' || {_NL} || detail
    WHEN 'git' THEN '# Git Commit' || {_NL} || {_NL} || '**Hash:** ' || detail || {_NL} || '**Author:** ' || actor || {_NL} || '**Message:**' || {_NL} || title || {_NL} || {_NL} || '**Files Changed:**' || {_NL} || content
    WHEN 'browser' THEN '# 浏览: ' || title || {_NL} || {_NL} || '**URL:** ' || detail || {_NL} || {_NL} || content WHEN 'preference' THEN '# 偏好: ' || title || {_NL} || {_NL} || '**值:** ' || detail || {_NL} || {_NL} || '**上下文:**' || {_NL} || content ELSE content END AS content,
  CASE kind WHEN 'decision' THEN 'decision' WHEN 'preference' THEN 'preference' ELSE 'episodic' END AS memory_type, CASE WHEN kind IN ('decision', 'git') THEN 'project' WHEN kind = 'preference' THEN 'global' ELSE 'session' END AS scope,
  CASE kind WHEN 'agent' THEN 0.8 WHEN 'decision' THEN 0.9 WHEN 'git' THEN 1.0 WHEN 'browser' THEN 0.6 WHEN 'chat' THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence,
  CASE kind WHEN 'agent' THEN 'agent' WHEN 'decision' THEN 'project' WHEN 'git' THEN 'project' ELSE 'private' END AS visibility,
  CASE kind WHEN 'git' THEN 'git,commit' WHEN 'browser' THEN 'browser,web' WHEN 'chat' THEN detail || ',chat' WHEN 'preference' THEN 'preference,' || title ELSE '' END AS tags,
  CASE WHEN kind IN ('agent', 'decision') THEN 'agent' WHEN kind = 'chat' THEN CASE WHEN detail = 'wechat' THEN 'wechat' ELSE 'manual' END WHEN kind = 'preference' THEN 'manual' ELSE kind END AS source_type, CASE WHEN kind IN ('git', 'chat') THEN actor END AS owner FROM a"""))
def activity_to_memory(spark: SparkSession, d: str) -> DataFrame:
    """Activities of all kinds as memories."""
    rows = frames.table(spark, d, "events").selectExpr(
        "event_id", "element_at(array('agent', 'decision', 'git', 'browser', 'chat', 'preference'), cast(event_id % 6 AS int) + 1) AS kind", "case when event_id % 5 = 0 then 'line one\\nline two' else concat('title ', event_id) end AS title",
        "concat('body ', event_id) AS content", "case when event_id % 12 = 4 then 'wechat' else concat('d', event_id % 7) end AS detail", "concat('u', user_id) AS actor", "cast(null AS array<string>) AS tags",
    )
    found = exchange.activity_memories(rows)
    return found.withColumn("tags", F.array_join("tags", ","))
