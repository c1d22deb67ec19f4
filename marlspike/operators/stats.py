"""Counts and shares. Each report is one pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import is_vectorized


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, at most 100, two decimals; 0 of nothing."""
    return F.when(whole > 0, F.round(F.least(F.lit(100.0), part / whole * 100), 2)).otherwise(0.0)


def by_source(doc: DataFrame, kind: str) -> DataFrame:
    """Active documents of a kind: total and embedded by source."""
    active = doc.where((F.col("type") == kind) & (F.col("status") == "active"))
    return active.groupBy("source_type").agg(F.count("*").alias("total"), count_if(is_vectorized(F.col("metadata"))).alias("embedded"))


def knowledge_stats(doc: DataFrame) -> DataFrame:
    active = doc.where("type = 'knowledge' AND status = 'active'")
    out = active.agg(F.count("*").alias("total"), count_if(is_vectorized(F.col("metadata"))).alias("embedded"))
    return out.withColumn("pending", F.col("total") - F.col("embedded"))


def data_stats(doc: DataFrame) -> DataFrame:
    """One row of counts by kind and status, of embedded ones by kind, and megabytes of content."""
    kinds, states = ("knowledge", "memory", "session"), ("active", "archived", "deleted")
    has = lambda k, s: (F.col("type") == k) & (F.col("status") == s)
    counts = [count_if(has(k, s)).alias(f"{k}_{s}") for k in kinds for s in states]
    embedded = [count_if(has(k, "active") & is_vectorized(F.col("metadata"))).alias(f"{k}_embedded") for k in kinds]
    size = F.round(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)) / (1024 * 1024), 2).alias("content_mb")
    return doc.agg(*counts, *embedded, F.count("*").alias("total"), size)


def progress(doc: DataFrame) -> DataFrame:
    """Per kind: active, embedded, their share, and the last change."""
    active = doc.where("status = 'active'").groupBy("type").agg(F.count("*").alias("total"), count_if(is_vectorized(F.col("metadata"))).alias("embedded"), F.max("updated_at").alias("updated_at"))
    return active.withColumn("percent", percent(F.col("embedded"), F.col("total")))


def totals_by_source(doc: DataFrame, kind: str) -> DataFrame:
    """As by_source, with the grand total in the row of source ``all``."""
    active = doc.where((F.col("type") == kind) & (F.col("status") == "active"))
    out = active.rollup("source_type").agg(F.count("*").alias("total"), count_if(is_vectorized(F.col("metadata"))).alias("embedded"), F.grouping("source_type").alias("all"))
    return out.select(F.when(F.col("all") == 1, "all").otherwise(F.col("source_type")).alias("source_type"), "total", "embedded")


def task_progress(doc: DataFrame, knowledge_ext: DataFrame, task: DataFrame) -> DataFrame:
    """One row: stage, indexed_count, vectorized_count, total_files, index_progress, vectorize_progress and last_indexed.

    ``task`` (stage, total, indexed, vectorized) has a row while one runs. While files are scanned or indexed, their share
    is of what the task found, while rows are vectorized, theirs is; all other shares are of the current versions.
    """
    known = knowledge_ext.agg(count_if(F.col("is_current")).alias("db_total"))
    active = (F.col("type") == "knowledge") & (F.col("status") == "active")
    there = doc.agg(count_if(active).alias("db_indexed"), count_if(active & is_vectorized(F.col("metadata"))).alias("db_vectorized"), F.max(F.when(F.col("type") == "knowledge", F.col("updated_at"))).alias("last_indexed"))
    rows = there.join(F.broadcast(known)).join(F.broadcast(task.limit(1)), F.lit(True), "left")
    indexing, vectorizing = F.coalesce(F.col("stage").isin("indexing", "scanning"), F.lit(False)), F.coalesce(F.col("stage").startswith("vectorizing"), F.lit(False))
    busy = F.col("stage").isNotNull() & ~vectorizing  # whatever else runs shows its own counts
    return rows.select(
        F.when(vectorizing, "vectorizing").otherwise(F.coalesce("stage", F.lit("idle"))).alias("stage"), F.when(busy, F.col("total")).otherwise(F.col("db_total")).alias("total_files"),
        F.when(busy, F.col("indexed")).otherwise(F.col("db_indexed")).alias("indexed_count"), F.when(busy & ~indexing, F.col("vectorized")).otherwise(F.col("db_vectorized")).alias("vectorized_count"),
        F.when(indexing, percent(F.col("indexed"), F.col("total"))).otherwise(percent(F.col("db_indexed"), F.col("db_total"))).alias("index_progress"),
        F.when(vectorizing, percent(F.col("vectorized"), F.col("total"))).otherwise(percent(F.col("db_vectorized"), F.col("db_total"))).alias("vectorize_progress"), "last_indexed",
    )


def grouped(rows: DataFrame, by: str) -> DataFrame:
    """How many rows each group of a list has, and its oldest and newest."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min("updated_at").alias("oldest"), F.max("updated_at").alias("newest"))


def coverage(doc: DataFrame) -> DataFrame:
    """Whole percents of embedded documents by kind and over all."""
    out = doc.where("status = 'active'").rollup("type").agg(F.count("*").alias("total"), count_if(is_vectorized(F.col("metadata"))).alias("embedded"))
    return out.select(F.coalesce("type", F.lit("all")).alias("type"), "total", "embedded", F.round(F.col("embedded") / F.col("total") * 100).cast("long").alias("percent"))


def agent_activity(doc: DataFrame) -> DataFrame:
    """Per agent: memories, sessions, and the memories' share of both."""
    agent = F.regexp_replace("source_type", "_session$", "")
    out = doc.where("status = 'active' AND type <> 'knowledge'").groupBy(agent.alias("agent")).agg(count_if(F.col("type") == "memory").alias("memories"), count_if(F.col("type") == "session").alias("sessions"))
    return out.withColumn("memory_percent", percent(F.col("memories"), F.col("memories") + F.col("sessions")))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts by source of several tables, added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source_type").agg(F.sum("n").alias("n"))


def watermark_lines(texts: DataFrame, id_column: str = "id", most_bytes: int = 80, times: int = 3) -> DataFrame:
    """Short lines that occur at least three times in a text, with their number."""
    from ..functions.text import lines, trim

    each = texts.select(id_column, F.explode(lines(F.col("content"))).alias("line")).select(id_column, trim(F.col("line")).alias("line"))
    short = each.where((F.col("line") != "") & (F.octet_length("line") < most_bytes))
    return short.groupBy(id_column, "line").agg(F.count("*").alias("times")).where(F.col("times") >= times)
