"""State changes as functions from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, rows: DataFrame, order: Column | str) -> DataFrame:
    """Rows whose id is not there yet; of equal new ids the first by order."""
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("place = 1").drop("place")
    return first.join(old.select("id"), "id", "left_anti")


def upsert(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Old rows with the new ones' values where they have any, and rows that are new."""
    values = [c for c in old.columns if c != "id"]
    both = old.join(rows.select("id", *(F.col(c).alias(f"new_{c}") for c in values if c in rows.columns)), "id", "full_outer")
    return both.select("id", *(F.coalesce(f"new_{c}", c).alias(c) if c in rows.columns else c for c in values))


def set_status(doc: DataFrame, condition: Column, status: str) -> DataFrame:
    return doc.withColumn("status", F.when(condition, status).otherwise(F.col("status")))


def deletion(ids: list[str] | None = None, source_type: str | None = None, all_of: str | None = None) -> Column:
    """The rows that a deletion means, by the first criterion that is given: ids, the memories of a source, or all knowledge or memories."""
    if ids:
        return F.col("id").isin(ids)
    if source_type:
        return F.coalesce((F.col("source_type") == source_type) & (F.col("type") == "memory"), F.lit(False))
    if all_of in ("knowledge", "memory"):
        return F.col("type") == all_of
    raise ValueError("no criterion for a deletion")


def batch_delete(doc: DataFrame, now: Column, ids: list[str] | None = None, source_type: str | None = None, all_of: str | None = None) -> DataFrame:
    """Marks rows as deleted, with the moment, whatever their status was."""
    condition = deletion(ids, source_type, all_of)
    return set_status(doc, condition, "deleted").withColumn("updated_at", F.when(condition, now).otherwise(F.col("updated_at")))


def restore_deleted(doc: DataFrame) -> DataFrame:
    return set_status(doc, F.col("status") == "deleted", "active")


def candidate_queue(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """Waiting candidates, those that are trusted first, then the newest."""
    waiting = candidates.where("review_status = 'needs_review'").withColumn("ai_review", F.when(F.col("confidence") >= 0.5, "uncertain").otherwise("rejected"))
    return waiting.orderBy(F.when(F.col("confidence") >= 0.5, 0).otherwise(1), F.desc("created_at"), "id").limit(limit)


def approve(candidates: DataFrame, ids: Column) -> DataFrame:
    """The documents that approved candidates become; only waiting ones can be approved."""
    chosen = candidates.where((F.col("review_status") == "needs_review") & ids)
    return chosen.select(
        "id", F.lit("memory").alias("type"), "title", "content", F.lit("active").alias("status"), F.coalesce("source_agent_id", F.lit("manual")).alias("source_type"),
        F.lit("shared").alias("scope"), F.lit("shared").alias("visibility"), F.lit(0.9).alias("confidence"), F.col("proposed_type").alias("memory_type"),
    )


def review(candidates: DataFrame, approved: Column, rejected: Column) -> DataFrame:
    waiting = F.col("review_status") == "needs_review"
    return candidates.withColumn("review_status", F.when(waiting & approved, "approved").when(waiting & rejected, "rejected").otherwise(F.col("review_status")))


def unsynced(pushed: DataFrame, known: DataFrame) -> DataFrame:
    """The pushed rows whose id isn't known yet."""
    return pushed.join(known.select("id"), "id", "left_anti")


def pulled(rows: DataFrame, since: Column, limit: int = 100) -> DataFrame:
    """The newest rows after a moment, with has_more: whether there are others than these."""
    newer = rows.where(F.col("updated_at") > since)
    more = newer.agg((F.count("*") > limit).alias("has_more"))
    return newer.orderBy(F.desc("updated_at"), "id").limit(limit).join(F.broadcast(more))


#: Days that memories of a scope live; others live as long as those of a project, global ones for ever.
DAYS = {"session": 7, "project": 90}


def expires_at(scope: Column, at: Column) -> Column:
    days = F.when(scope == "session", DAYS["session"]).when(scope != "global", DAYS["project"])
    return F.when(days.isNotNull(), F.timestamp_add("DAY", days, at))


def relabelled(sessions: DataFrame) -> DataFrame:
    """Rows whose titles show that they are sessions get the kind of a session as their source."""
    bare = F.regexp_replace("source_type", "_session$", "")
    dated = (bare == "hermes") & (F.col("title").rlike("^20[0-9][0-9]") | F.col("source_type").endswith("_session"))
    named = bare.isin("gemini", "codex", "openclaw") & F.lower("title").contains("session")
    return sessions.withColumn("source_type", F.when(dated | named, F.concat(bare, F.lit("_session"))).otherwise(F.col("source_type")))


def last_seen(events: DataFrame, key: Column, at: Column) -> DataFrame:
    return events.groupBy(key.alias("agent")).agg(F.max(at).alias("last_seen"))


def offline(seen: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Whether the last sign of life is longer ago than so many minutes."""
    return seen.withColumn("offline", F.timestamp_diff("SECOND", F.col("last_seen"), now) > 60 * minutes)


def merge_settings(current: Column, backup: Column) -> Column:
    """A map with the backup's keys that are missing added; what is there stays."""
    return F.map_concat(current, F.map_filter(backup, lambda k, _: ~F.map_contains_key(current, k)))
