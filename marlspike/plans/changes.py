"""Queries over changes of the corpus: versions, upserts, reviews, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import administration, entities, lifecycle, search, versioning
from ..sources import frames
from . import sql as S
from .registration import Registry

registry = Registry()
query = registry.query

_JOINED = "FROM (SELECT id, source_path, content FROM knowledge WHERE status = 'active') AS k FULL OUTER JOIN scan ON scan.path = k.source_path"
_CHANGE = "CASE WHEN k.id IS NULL THEN 'new' WHEN scan.path IS NULL THEN 'missing' WHEN sha256(k.content) = sha256(scan.content) THEN 'same' ELSE 'changed' END"


def _active(spark: SparkSession, d: str) -> DataFrame:
    return frames.knowledge(spark, d).where("status = 'active'")


@query(S.with_(f"{S.KNOWLEDGE}, {S.SCAN}", f"SELECT coalesce(k.source_path, scan.path) AS path, k.id, {_CHANGE} AS change {_JOINED}"))
def change_classify(spark: SparkSession, d: str) -> DataFrame:
    return versioning.classify(_active(spark, d), frames.second_scan(spark, d))


@query(S.with_(f"{S.KNOWLEDGE}, {S.SCAN}", "SELECT id, source_path FROM knowledge WHERE status = 'active' AND source_path NOT IN (SELECT path FROM scan)"))
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    return versioning.missing(_active(spark, d), frames.second_scan(spark, d)).select("id", "source_path")


_NEXT = "(sha256(concat_ws(':', coalesce(k.source_path, scan.path), CAST(coalesce(v, 0) + 1 AS VARCHAR))))"
_KNOWN = "FROM (SELECT id, source_path, content, coalesce(version, 1) AS v, updated_at FROM knowledge LEFT JOIN knowledge_ext USING (id) WHERE status = 'active') AS k FULL OUTER JOIN scan ON scan.path = k.source_path"


_NOW = "timestamp_ntz'2024-03-01 00:00:00'"
_DATED = "k.updated_at - INTERVAL 1 DAY"


@query(S.with_(f"{S.KNOWLEDGE}, {S.EXTS}, {S.SCAN}", f"SELECT coalesce(k.source_path, scan.path) AS path, id, v AS version, CASE WHEN scan.path IS NULL THEN 'deleted' WHEN sha256(k.content) = sha256(scan.content) THEN 'active' ELSE 'archived' END AS status, scan.path IS NOT NULL AND sha256(k.content) = sha256(scan.content) AS is_current, sha256(k.content) AS content_hash, {_DATED} AS created_at, TIMESTAMP '2024-03-01' AS updated_at {_KNOWN} WHERE id IS NOT NULL UNION ALL SELECT scan.path, {_NEXT}, coalesce(v, 0) + 1, 'active', true, sha256(scan.content), coalesce({_DATED}, TIMESTAMP '2024-03-01'), TIMESTAMP '2024-03-01' {_KNOWN} WHERE scan.path IS NOT NULL AND (id IS NULL OR sha256(k.content) <> sha256(scan.content))"))
def reindex_apply(spark: SparkSession, d: str) -> DataFrame:
    existing = _active(spark, d).withColumn("created_at", F.expr("updated_at - INTERVAL 1 DAY"))
    return versioning.reindex(existing, frames.knowledge_ext(spark, d), frames.second_scan(spark, d), F.expr(_NOW))


_MTIME = "TIMESTAMP '2024-01-01' + to_minutes(doc_id"
_MANIFEST = f"m AS (SELECT '/kb/' || doc_id AS path, {_MTIME}) AS mtime, length(text) AS length FROM documents WHERE doc_id % 10 <> 3), l AS (SELECT '/kb/' || doc_id AS path, {_MTIME} + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END) AS mtime, length(text) + CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS length FROM documents WHERE doc_id % 7 <> 0)"


@query(S.with_(_MANIFEST, "SELECT l.path, CASE WHEN m.path IS NULL THEN 'new' ELSE 'changed' END AS what FROM l LEFT JOIN m USING (path) WHERE m.path IS NULL OR m.mtime <> l.mtime OR m.length <> l.length UNION ALL SELECT path, 'gone' FROM m WHERE path NOT IN (SELECT path FROM l)"))
def index_delta(spark: SparkSession, d: str) -> DataFrame:
    """What a scan has to read, by the stored state of the last one, and what is gone."""
    docs = frames.table(spark, d, "documents").where("text IS NOT NULL")
    files = lambda more, longer: docs.select("doc_id", F.expr("concat('/kb/', doc_id)").alias("path"), frames.after("01", f"doc_id + {more}").alias("mtime"), F.expr(f"char_length(text) + {longer}").alias("length"))
    manifest = files("0", "0").where("doc_id % 10 <> 3")
    listing = files("case when doc_id % 5 = 1 then 1 else 0 end", "case when doc_id % 5 = 2 then 1 else 0 end").where("doc_id % 7 <> 0")
    known = manifest.select("path", F.lit("changed").alias("known"))
    read = versioning.to_read(listing, manifest).join(known, "path", "left").select("path", F.coalesce("known", F.lit("new")).alias("what"))
    return read.unionByName(versioning.vanished(listing, manifest).select("path", F.lit("gone").alias("what")))


@query("WITH e AS (SELECT user_id % 50 AS path, event_id AS seq, event_type AS content_hash FROM events), f AS (SELECT * FROM (SELECT *, lag(content_hash) OVER (PARTITION BY path ORDER BY seq) AS b FROM e) WHERE b IS NULL OR b <> content_hash) SELECT path, seq, content_hash, row_number() OVER (PARTITION BY path ORDER BY seq) AS version, lead(seq) OVER (PARTITION BY path ORDER BY seq) IS NULL AS is_current FROM f")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    events = frames.table(spark, d, "events")
    return versioning.history(events.select((F.col("user_id") % 50).alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("content_hash")))


@query(S.with_(f"{S.KNOWLEDGE}, {S.EXTS}", "SELECT id, source_path, version FROM knowledge LEFT JOIN knowledge_ext USING (id) WHERE status = 'active' AND coalesce(is_current, true)"))
def current_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return versioning.current(frames.knowledge(spark, d), frames.knowledge_ext(spark, d)).select("id", "source_path", "version")


@query(S.with_(f"{S.DOC}, {S.EXTS}", "SELECT id FROM doc WHERE type = 'knowledge' AND id NOT IN (SELECT id FROM knowledge_ext)"))
def orphan_docs(spark: SparkSession, d: str) -> DataFrame:
    return versioning.orphans(frames.doc(spark, d), frames.knowledge_ext(spark, d)).select("id")


@query(S.with_(f"{S.DOC}, {S.EXTS}", "SELECT id, type FROM doc WHERE type <> 'knowledge' OR id IN (SELECT id FROM knowledge_ext WHERE is_current)"))
def cleanup_old_versions(spark: SparkSession, d: str) -> DataFrame:
    return versioning.cleanup_old_versions(frames.doc(spark, d), frames.knowledge_ext(spark, d)).select("id", "type")


@query(S.with_(S.DOC, "SELECT id, CASE WHEN gone THEN 'deleted' ELSE status END AS status, CASE WHEN gone THEN TIMESTAMP '2024-03-01' ELSE updated_at END AS updated_at FROM (SELECT *, source_type = 'openclaw' AND type = 'memory' AS gone FROM doc)"))
def batch_delete(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.batch_delete(frames.doc(spark, d), F.expr(_NOW), source_type="openclaw").select("id", "status", "updated_at")


@query(S.with_(S.DOC, "SELECT id, CASE WHEN status = 'deleted' THEN 'active' ELSE status END AS status FROM doc"))
def restore_deleted(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.restore_deleted(frames.doc(spark, d)).select("id", "status")


@query(S.with_(S.DOC, "SELECT id, status, CASE WHEN type NOT IN ('session', 'memory') THEN metadata END AS metadata FROM doc"))
def clear_metadata(spark: SparkSession, d: str) -> DataFrame:
    return administration.clear({"doc": frames.doc(spark, d)}, {"session_metadata", "memory_metadata"}, "CONFIRM_CLEAR")["doc"].select("id", "status", "metadata")


@query(S.with_(S.DOC, "SELECT id, type FROM doc WHERE NOT starts_with(source_path, '/kb/src0/')"))
def delete_config(spark: SparkSession, d: str) -> DataFrame:
    return frames.doc(spark, d).where(~F.col("source_path").startswith("/kb/src0/")).select("id", "type")


@query(S.with_(f"{S.MEMORIES}", "SELECT 'm' || item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'new ' || item_id ELSE 'memory ' || item_id END AS title, text AS content FROM benchmark UNION ALL SELECT 'x' || item_id, 'new ' || item_id, text FROM benchmark WHERE item_id % 5 = 0"))
def upsert_docs(spark: SparkSession, d: str) -> DataFrame:
    items = frames.table(spark, d, "benchmark")
    old = frames.memories(spark, d).select("id", "title", "content")
    title = F.expr("concat('new ', item_id)").alias("title")
    rows = items.where("item_id % 2 = 0").select(F.expr("concat('m', item_id)").alias("id"), title, F.lit(None).cast("string").alias("content"))
    return lifecycle.upsert(old, rows.unionByName(items.where("item_id % 5 = 0").select(F.expr("concat('x', item_id)").alias("id"), title, F.col("text").alias("content"))))


@query(S.with_(S.MEMORIES, "SELECT id, CASE WHEN item_id % 6 = 0 THEN NULL WHEN item_id % 3 = 0 THEN 'patched' ELSE title END AS title, CASE WHEN item_id % 6 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN item_id % 3 = 0 THEN TIMESTAMP '2024-03-01' ELSE updated_at END AS updated_at FROM memories JOIN (SELECT item_id FROM benchmark) ON id = 'm' || item_id"))
def patch_update(spark: SparkSession, d: str) -> DataFrame:
    """Patches that give one field, give null, or are of ids that nobody has."""
    old = frames.memories(spark, d).select("id", "title", "status", "updated_at")
    change = lambda where, key, given, title, status: frames.table(spark, d, "benchmark").where(where).select(
        F.expr(f"concat('{key}', item_id)").alias("id"), F.expr(_NOW).alias("at"), F.lit(len(given)).cast("long").alias("seq"), F.lit("set").alias("op"),
        F.array(*map(F.lit, given)).alias("given"), F.lit(title).cast("string").alias("title"), F.lit(status).cast("string").alias("status"),
    )
    changes = change("item_id % 6 = 0", "m", ["title", "status"], None, "archived").unionByName(change("item_id % 3 = 0", "m", ["title"], "patched", None)).unionByName(change("true", "x", ["title"], "unknown", None))
    return entities.patched(old, changes, ["title", "status"])


@query("SELECT id, min(conv_id) AS conv_id FROM (SELECT conv_id, sha256(concat_ws(':', 'session', CAST(conv_id % 30 AS VARCHAR))) AS id FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE id NOT IN (SELECT sha256(concat_ws(':', 'session', CAST(conv_id AS VARCHAR))) FROM conversations WHERE conv_id < 5) GROUP BY id")
def pull_dedup(spark: SparkSession, d: str) -> DataFrame:
    convs = frames.table(spark, d, "conversations").select("conv_id").distinct()
    key = lambda c: F.sha2(F.concat_ws(":", F.lit("session"), c.cast("string")), 256)
    old = convs.where("conv_id < 5").select(key(F.col("conv_id")).alias("id"))
    return lifecycle.insert_or_ignore(old, convs.select(key(F.col("conv_id") % 30).alias("id"), "conv_id"), "conv_id")


@query("SELECT 'm' || item_id AS id FROM benchmark WHERE item_id % 4 = 0")
def sync_push_new(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.unsynced(frames.memories(spark, d).select("id"), frames.memory_ext(spark, d))


@query(S.with_(S.MEMORIES, "SELECT id, updated_at, has_more FROM (SELECT id, updated_at, count(*) OVER () > 20 AS has_more FROM memories WHERE updated_at > TIMESTAMP '2024-01-20 00:05:00') ORDER BY updated_at DESC, id LIMIT 20"))
def sync_pull(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.pulled(frames.memories(spark, d).select("id", "updated_at"), F.expr("timestamp_ntz'2024-01-20 00:05:00'"), 20)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "benchmark").select(
        F.expr("concat('c', item_id)").alias("id"), F.expr("concat('candidate ', item_id)").alias("title"), F.col("text").alias("content"), F.lit("semantic").alias("proposed_type"),
        F.expr("case when item_id % 3 = 0 then null else 'codex' end").alias("source_agent_id"), F.expr("(item_id % 10) / 10.0D").alias("confidence"),
        F.expr("element_at(array('needs_review', 'approved', 'needs_review', 'rejected'), cast(item_id % 4 as int) + 1)").alias("review_status"), frames.after("05", "item_id").alias("created_at"),
    )


_CANDIDATES = "candidates AS (SELECT item_id, 'c' || item_id AS id, 'candidate ' || item_id AS title, text AS content, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'codex' END AS source_agent_id, (item_id % 10) / 10.0::DOUBLE AS confidence, ['needs_review', 'approved', 'needs_review', 'rejected'][item_id % 4 + 1] AS review_status, TIMESTAMP '2024-01-05' + to_minutes(item_id) AS created_at FROM benchmark)"


@query(S.with_(_CANDIDATES, "SELECT id, confidence, CASE WHEN confidence >= 0.5 THEN 'uncertain' ELSE 'rejected' END AS ai_review, created_at FROM candidates WHERE review_status = 'needs_review' ORDER BY CASE WHEN confidence >= 0.5 THEN 0 ELSE 1 END, created_at DESC, id LIMIT 12"))
def candidate_queue(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.candidate_queue(_candidates(spark, d), 12).select("id", "confidence", "ai_review", "created_at")


@query(S.with_(_CANDIDATES, "SELECT id, title, coalesce(source_agent_id, 'manual') AS source_type, 'shared' AS scope, 0.9::DOUBLE AS confidence FROM candidates WHERE review_status = 'needs_review' AND confidence >= 0.4"))
def approve_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.approve(_candidates(spark, d), F.col("confidence") >= 0.4).select("id", "title", "source_type", "scope", "confidence")


@query(S.with_(_CANDIDATES, "SELECT id, CASE WHEN review_status = 'needs_review' AND confidence >= 0.7 THEN 'approved' WHEN review_status = 'needs_review' AND confidence < 0.3 THEN 'rejected' ELSE review_status END AS review_status FROM candidates"))
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.review(_candidates(spark, d), F.col("confidence") >= 0.7, F.col("confidence") < 0.3).select("id", "review_status")


@query("SELECT review_status, count(*) AS n FROM (SELECT ['needs_review', 'approved', 'needs_review', 'rejected'][item_id % 4 + 1] AS review_status FROM benchmark) GROUP BY review_status")
def pending_counts(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).groupBy("review_status").agg(F.count("*").alias("n"))


@query(S.with_(S.SESSIONS, "SELECT id, CASE WHEN source_type IN ('codex_session', 'gemini_session') AND contains(lower(title), 'session') THEN source_type WHEN source_type = 'openclaw' THEN 'openclaw_session' ELSE source_type END AS source_type FROM sessions"))
def relabel_sessions(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.relabelled(frames.sessions(spark, d)).select("id", "source_type")


@query(S.with_(S.FULL, "SELECT id, scope, CASE scope WHEN 'session' THEN updated_at + INTERVAL 7 DAY WHEN 'global' THEN NULL ELSE updated_at + INTERVAL 90 DAY END AS expires_at FROM defaulted WHERE type = 'memory'"))
def memory_level_expiry(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_memory_defaults(frames.memories(spark, d), frames.memory_ext(spark, d))
    return rows.select("id", "scope", lifecycle.expires_at(F.col("scope"), F.col("updated_at")).alias("expires_at"))


@query(S.with_(S.MEMORIES, "SELECT id, title, CASE WHEN item_id % 2 = 0 THEN content || chr(10) || chr(10) || 'more' ELSE content END AS content FROM memories JOIN (SELECT item_id FROM benchmark) ON id = 'm' || item_id"))
def import_merge(spark: SparkSession, d: str) -> DataFrame:
    old = frames.memories(spark, d).select("id", "title", "content")
    rows = frames.table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.expr("concat('m', item_id)").alias("id"), F.lit("more").alias("extra"))
    return old.join(rows, "id", "left").select("id", "title", F.concat_ws("\n\n", "content", "extra").alias("content"))


@query(S.with_(S.FULL, "SELECT id FROM defaulted WHERE status = 'active' AND confidence >= 0.7 AND updated_at BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-21' AND metadata = '[\"note\"]'"))
def context_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_memory_defaults(frames.doc(spark, d), frames.memory_ext(spark, d)).where("status = 'active'")
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-{n} 00:00:00'")
    return rows.where(search.filters(least_confidence=0.7, since=day(20), until=day(21), tags=["note", "other"])).select("id")
