"""Queries over hybrid retrieval, ingest and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exchange, ingest, retrieval, search, tables
from ..sources import frames
from . import sql as S
from .registration import Registry

registry = Registry()
query = registry.query

#: The request of the retrieval queries: its words, and the row whose vector stands for its embedding.
WORDS, ROW = "the ciónta estion", 0
_HELD = " + ".join("CAST(" + " OR ".join(f"coalesce(contains({S.fold(c)}, '{w}'), false)" for c in ("title", "content", "metadata")) + " AS INTEGER)" for w in sorted(WORDS.split()))
_FUSED = f"""
, kw AS (
  SELECT id, CAST(row_number() OVER (ORDER BY held DESC, updated_at DESC, id) AS INTEGER) AS rank FROM (SELECT id, updated_at, {_HELD} AS held FROM doc WHERE status = 'active') WHERE held > 0 QUALIFY rank <= 200
), ve AS (
  SELECT 'k' || vec_id AS id, CAST(row_number() OVER (ORDER BY similarity DESC, 'k' || vec_id) AS INTEGER) AS rank
  FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {ROW})) AS similarity FROM embeddings) QUALIFY rank <= 200
)
SELECT id, kw.rank AS keyword_rank, ve.rank AS vector_rank, round(coalesce(1.0::DOUBLE / (60 + kw.rank), 0) + coalesce(1.0::DOUBLE / (60 + ve.rank), 0), 12) AS score FROM kw FULL JOIN ve USING (id)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "embeddings").select(F.expr("concat('k', vec_id)").alias("id"), "embedding")


def _wanted(spark: SparkSession, d: str) -> list[float]:
    return _vectors(spark, d).where(f"id = 'k{ROW}'").first().embedding


@query(S.with_(S.DOC, _FUSED).replace(")\n\n,", ")\n,"))
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector ranks of a request, fused."""
    found = retrieval.fused({"keyword": retrieval.keyword_ranks(frames.doc(spark, d), WORDS), "vector": retrieval.vector_ranks(_vectors(spark, d), _wanted(spark, d))})
    return found.withColumn("score", F.round("score", 12))


@query()
def hybrid_pack(spark: SparkSession, d: str) -> DataFrame:
    """The diverse hits of the same request whose previews fit into 600 tokens."""
    return retrieval.hybrid(frames.doc(spark, d), _vectors(spark, d), WORDS, _wanted(spark, d), 600)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A request with two events per document: some without a path, with a size below zero, with a digest that is none, and some that are no JSON or name no device."""
    event = F.struct(
        F.expr("concat('e', doc_id)").alias("event_id"), F.lit("s").alias("data_source_id"), F.lit("file_modified").alias("event_type"), F.expr("case when doc_id % 5 = 0 then null else concat('/KB/', lang, '/', doc_id, '.md') end").alias("path"),
        F.expr("case when doc_id % 7 = 0 then -1 else n_chars end").alias("size_bytes"), F.expr("case when doc_id % 11 = 0 then 'x' else sha2(cast(doc_id AS string), 256) end").alias("sha256"),
    )
    other = F.struct(F.expr("concat('o', doc_id)").alias("event_id"), F.lit("s").alias("data_source_id"), F.lit("file_created").alias("event_type"), F.expr("concat('/Other/', doc_id)").alias("path"))
    text = F.concat(F.lit("{"), F.when(F.expr("doc_id % 13 <> 0"), F.lit('"device_id":"dev",')).otherwise(""), F.lit('"events":['), F.to_json(event), F.lit(","), F.to_json(other), F.lit("]"), F.when(F.expr("doc_id % 17 = 0"), "").otherwise("}"))
    return frames.table(spark, d, "documents").select(F.expr("concat('r', doc_id)").alias("request_id"), text.alias("json"))


_WHOLE = "CASE WHEN doc_id % 17 = 0 THEN '$: no JSON' WHEN doc_id % 13 = 0 THEN '$.device_id: missing' END"
_PART = "concat_ws('; ', CASE WHEN doc_id % 5 = 0 THEN '$.path: missing' END, CASE WHEN doc_id % 7 = 0 THEN '$.size_bytes: less than 0' END, CASE WHEN doc_id % 11 = 0 THEN '$.sha256: doesn''t match ^[a-f0-9]{64}$' END)"
_ROWS = f"p AS (SELECT doc_id, 0 AS place, coalesce({_WHOLE}, {_PART}) AS violations FROM documents UNION ALL SELECT doc_id, 1, '' FROM documents WHERE {_WHOLE} IS NULL)"


@query(S.with_(_ROWS, "SELECT 'r' || doc_id AS request_id, CAST(place AS INTEGER) AS place, violations FROM p WHERE violations <> ''"))
def ingest_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What was handed in and isn't valid, with the reasons."""
    return ingest.rejected(ingest.file_event_parts(_requests(spark, d))).select("request_id", "place", F.array_join("violations", "; ").alias("violations"))


@query(S.with_(_ROWS, "SELECT sha256('events:r' || doc_id || ':' || place) AS id, CASE place WHEN 0 THEN 'e' ELSE 'o' END || doc_id AS event_id, 'dev' AS device_id, CASE place WHEN 0 THEN '/kb/' || lang || '/' || doc_id || '.md' ELSE '/other/' || doc_id END AS normalized_path, CASE place WHEN 0 THEN doc_id || '.md' ELSE CAST(doc_id AS VARCHAR) END AS file_name, CASE place WHEN 0 THEN 'md' END AS extension, CASE place WHEN 0 THEN CAST(n_chars AS BIGINT) END AS size_bytes, 'new' AS status FROM p JOIN documents USING (doc_id) WHERE violations = ''"))
def ingest_file_events(spark: SparkSession, d: str) -> DataFrame:
    """The files of the events that are valid."""
    rows = ingest.source_files(ingest.file_event_parts(_requests(spark, d)), F.expr("timestamp_ntz'2024-03-01 00:00:00'"))
    return rows.select("id", "event_id", "device_id", "normalized_path", "file_name", "extension", "size_bytes", "status")


_FIELDS = " || ',' || ".join(f"'\"' || replace({c}, '\"', '\"\"') || '\"'" for c in ("id", "title", "content", "memory_type", "scope", "source_type", "visibility", "status"))


@query(S.with_(S.FULL.replace("'private'", "'shared'"), f"SELECT id, {_FIELDS} || ',' || printf('%.2f', confidence) AS line, updated_at FROM defaulted WHERE status = 'archived' AND type = 'knowledge'"))
def export_selection(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the rows of one status and type."""
    rows = search.with_memory_defaults(frames.doc(spark, d), frames.memory_ext(spark, d), "shared")
    return exchange.export_lines(exchange.export_selection(rows, "archived", kind="knowledge"))


@query("SELECT doc_id, CAST(place AS INTEGER) AS place, substring(text, place * 400 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 101) // 400 + 1)) AS place FROM documents WHERE length(text) > 0)")
def chunk_lateral(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by a table function in a lateral join."""
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, c.place, c.chunk FROM {docs} AS d, LATERAL chunk_fixed(d.text, 500, 100) AS c", docs=frames.table(spark, d, "documents"))


@query(S.with_(S.MEMORIES, "SELECT id, unnest(CASE WHEN metadata LIKE '[%' THEN CAST(from_json(metadata, '[\"VARCHAR\"]') AS VARCHAR[]) ELSE [] END) AS tag FROM memories"))
def tags_lateral(spark: SparkSession, d: str) -> DataFrame:
    """A row per tag of a memory, by a table function in a lateral join."""
    tables.register(spark)
    return spark.sql("SELECT m.id, t.tag FROM {rows} AS m, LATERAL tags_of(m.metadata) AS t", rows=frames.memories(spark, d))
