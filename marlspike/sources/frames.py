"""The library's tables, derived from the test tables: documents are knowledge, conversations are sessions, benchmark items are memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def after(day: str, minutes: str):
    """A timestamp without zone, so many minutes after a day of January 2024."""
    return F.expr(f"timestampadd(MINUTE, cast({minutes} as int), timestamp_ntz'2024-01-{day} 00:00:00')")


def session_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and content: ``role: text`` lines in the order of turns."""
    turns = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("content"))


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.expr("concat('k', doc_id)").alias("id"), F.lit("knowledge").alias("type"), F.expr("concat('doc ', doc_id)").alias("title"), F.col("text").alias("content"),
        F.expr("case doc_id % 10 when 0 then 'deleted' when 1 then 'archived' else 'active' end").alias("status"), F.lit("knowledge").alias("source_type"),
        F.expr("concat('/kb/', source, '/', lang, '/', doc_id, '.md')").alias("source_path"),
        F.expr("""case doc_id % 4 when 0 then null when 1 then '[]' when 2 then '{}' else concat('["', lang, '","', source, '"]') end""").alias("metadata"),
        after("01", "doc_id").alias("updated_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_text(spark, sf_dir).select(
        F.expr("concat('s', conv_id)").alias("id"), F.lit("session").alias("type"), F.expr("concat('session ', conv_id)").alias("title"), "content",
        F.expr("case when conv_id % 10 = 0 then 'deleted' else 'active' end").alias("status"),
        F.expr("element_at(array('hermes_session', 'codex_session', 'gemini_session', 'openclaw_session', 'openclaw'), cast(conv_id % 5 as int) + 1)").alias("source_type"),
        F.expr("concat('/sessions/', conv_id, '.jsonl')").alias("source_path"), F.expr("""case when conv_id % 3 = 0 then '{}' else '["chat"]' end""").alias("metadata"),
        after("15", "conv_id").alias("updated_at"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.expr("concat('m', item_id)").alias("id"), F.lit("memory").alias("type"), F.expr("concat('memory ', item_id)").alias("title"), F.col("text").alias("content"),
        F.expr("case when item_id % 8 = 0 then 'deleted' else 'active' end").alias("status"),
        F.expr("element_at(array('hermes', 'codex', 'gemini', 'openclaw', 'manual'), cast(item_id % 5 as int) + 1)").alias("source_type"),
        F.expr("case when item_id % 3 = 0 then '' else concat('/mem/', item_id % 7, '.md') end").alias("source_path"),
        F.expr("""case item_id % 4 when 0 then null when 1 then '{}' else '["note"]' end""").alias("metadata"), after("20", "item_id").alias("updated_at"),
    )


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them in one table: id, type, title, content, status, source_type, source_path, metadata, updated_at."""
    return knowledge(spark, sf_dir).unionByName(sessions(spark, sf_dir)).unionByName(memories(spark, sf_dir))


def memory_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 4 <> 0").select(
        F.expr("concat('m', item_id)").alias("id"),
        F.expr("element_at(array('decision', 'episodic', 'semantic'), cast(item_id % 3 as int) + 1)").alias("memory_type"),
        F.lit("shared").alias("scope"), F.lit("shared").alias("visibility"),
        F.expr("element_at(array(0.9D, 0.4D, 0.7D), cast(item_id % 3 as int) + 1)").alias("confidence"),
    )


def knowledge_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(
        F.expr("concat('k', doc_id)").alias("id"), F.expr("1 + doc_id % 3").alias("version"), F.expr("doc_id % 10 <> 0").alias("is_current")
    )


def second_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge folder at a later time: path and content; some files are gone, some changed, some new."""
    docs = table(spark, sf_dir, "documents")
    again = docs.where("doc_id % 5 <> 0").select(
        F.expr("concat('/kb/', source, '/', lang, '/', doc_id, '.md')").alias("path"), F.expr("case when doc_id % 5 = 1 then concat(text, ' v2') else text end").alias("content")
    )
    new = docs.where("doc_id % 10 = 3").select(F.expr("concat('/kb/new/', doc_id, '.md')").alias("path"), F.col("text").alias("content"))
    return again.unionByName(new)


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of files: event_id, ts, key, path, kind (null where the kind is not watched)."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("key"), F.expr("concat('/kb/src', user_id % 20, '/', event_type, '.md')").alias("path"), "event_type",
        F.expr("case event_type when 'signup' then 'file_created' when 'click' then 'file_modified' when 'view' then 'file_modified' when 'error' then 'file_deleted' end").alias("kind"),
    )
