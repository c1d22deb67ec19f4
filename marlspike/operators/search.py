"""Listing, searching and context assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, UPPER, LOWER)


def matches(query: str, *columns: str) -> Column:
    """Whether one of the columns holds the query, upper or lower case of A-Z aside; its characters mean themselves."""
    wanted = query.translate(str.maketrans(UPPER, LOWER))
    return reduce(lambda a, b: a | b, (F.coalesce(folded(F.col(c)).contains(wanted), F.lit(False)) for c in columns))


def with_memory_defaults(doc: DataFrame, memory_ext: DataFrame, visibility: str = "private") -> DataFrame:
    """Documents with what is known of them as memories; what isn't has its default."""
    out = doc.join(memory_ext, "id", "left")
    return out.withColumns({
        "memory_type": F.coalesce("memory_type", F.lit("semantic")), "scope": F.coalesce("scope", F.lit("project")),
        "confidence": F.coalesce("confidence", F.lit(0.8)), "visibility": F.coalesce("visibility", F.lit(visibility)),
    })


def list_filter(source_type: str | None) -> Column:
    """Which documents a list of a source shows: all memories, knowledge, one kind of session, or memories of a source."""
    if source_type is None:
        return F.col("type") == "memory"
    if source_type == "knowledge":
        return F.col("type") == "knowledge"
    kind = "session" if source_type.endswith("_session") else "memory"
    return (F.col("type") == kind) & (F.col("source_type") == source_type)


def expanded(kind: str | None) -> Column:
    """Which documents a job for a type covers: knowledge, memory or session, the documents of one source, or all."""
    if kind is None:
        return F.lit(True)
    return F.col("type" if kind in ("knowledge", "memory", "session") else "source_type") == kind


def pending(doc: DataFrame, knowledge_ext: DataFrame, kind: str | None = None) -> DataFrame:
    """Active documents of a type that have no tags yet; of knowledge only current versions."""
    rows = doc.where((F.col("status") == "active") & expanded(kind) & ~parse.is_vectorized(F.col("metadata")))
    if kind != "knowledge":
        return rows
    return rows.join(knowledge_ext.where("NOT is_current").select("id"), "id", "left_anti")


def search_filter(source_types: str | None) -> Column:
    """Which documents a search over a comma-separated list of sources covers; ``x_session`` also covers sessions of ``x``."""
    wanted = [s.strip() for s in (source_types or "").split(",") if s.strip()]
    if not wanted:
        return F.lit(True)
    one = lambda s: (
        F.col("type") == "knowledge" if s == "knowledge"
        else (F.col("type") == "session") & F.col("source_type").isin(s, s.removesuffix("_session")) if s.endswith("_session")
        else (F.col("type") == "memory") & (F.col("source_type") == s)
    )
    return reduce(lambda a, b: a | b, map(one, wanted))


def filters(
    least_confidence: float | None = None, since: Column | None = None, until: Column | None = None, tags: list[str] | None = None, source_types: list[str] | None = None, types: list[str] | None = None
) -> Column:
    """What a request for context may ask of a row: all that is given, of tags at least one."""
    out = F.lit(True)
    if least_confidence is not None:
        out = out & (F.col("confidence") >= least_confidence)
    if since is not None:
        out = out & (F.col("updated_at") >= since)
    if until is not None:
        out = out & (F.col("updated_at") <= until)
    if tags:
        out = out & F.arrays_overlap(parse.tags(F.col("metadata")), F.array(*map(F.lit, tags)))
    if source_types:
        out = out & F.col("source_type").isin(source_types)
    if types:
        out = out & F.col("type").isin(types)
    return out


def listed(doc: DataFrame, memory_ext: DataFrame, source_type: str | None, limit: int = 100, offset: int = 0, preview: int = 200) -> DataFrame:
    active = doc.where((F.col("status") == "active") & list_filter(source_type))
    rows = with_memory_defaults(active, memory_ext).orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)
    return rows.select("id", "title", F.substring("content", 1, preview).alias("preview"), "source_type", "memory_type", "scope", "confidence", "visibility")


def search(doc: DataFrame, memory_ext: DataFrame, query: str, source_types: str | None = None, limit: int = 50, preview: int = 500, where: Column | None = None) -> DataFrame:
    """Active documents whose title, content or tags hold the query, and that filters() let through, the newest first."""
    hits = doc.where((F.col("status") == "active") & search_filter(source_types) & matches(query, "title", "content", "metadata"))
    rows = with_memory_defaults(hits, memory_ext).where(F.lit(True) if where is None else where).orderBy(F.desc("updated_at"), "id").limit(limit)
    return rows.select("id", "type", "title", F.substring("content", 1, preview).alias("preview"), "source_type", "memory_type", "confidence")


def ranked(doc: DataFrame, memory_ext: DataFrame, query: str, limit: int, where: Column | None = None) -> DataFrame:
    """Hits in title, content or tags with their rank: knowledge first, then the most trusted, then the newest."""
    hits = doc.where((F.col("status") == "active") & matches(query, "title", "content", "metadata"))
    first = F.when(F.col("type") == "knowledge", 0).otherwise(1)
    rows = with_memory_defaults(hits, memory_ext).where(F.lit(True) if where is None else where)
    return rows.withColumn("first", first).orderBy("first", F.desc("confidence"), F.desc("updated_at"), "id").limit(limit)


def context_pack(doc: DataFrame, memory_ext: DataFrame, query: str, limit: int = 10, where: Column | None = None) -> DataFrame:
    """The best hits, one per file: twice as many are ranked, of each path the first stays, then they are cut to the limit.

    Windows run over the few ranked rows only.
    """
    order = (F.col("first"), F.desc("confidence"), F.desc("updated_at"), F.col("id"))
    some = ranked(doc, memory_ext, query, 2 * limit, where)
    place = F.row_number().over(Window.partitionBy("source_path").orderBy(*order))
    one = some.withColumn("place", place).where((F.coalesce("source_path", F.lit("")) == "") | (F.col("place") == 1))
    rows = one.orderBy(*order).limit(limit)
    return rows.select("id", "title", F.substring("content", 1, 500).alias("preview"), "type", parse.source_label(F.col("source_type")).alias("label"), "confidence")


def context_confidence(pack: DataFrame) -> DataFrame:
    """0 without hits, 0.95 with knowledge among them, else 0.8."""
    found = pack.agg(F.count("*").alias("n"), F.bool_or(F.col("type") == "knowledge").alias("known"))
    return found.select(F.when(F.col("n") == 0, 0.0).when(F.col("known"), 0.95).otherwise(0.8).alias("confidence"), "n")
