"""Queries that list, search, count, rank and export the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, vector
from ..operators import exchange, search, stats
from ..sources import frames
from . import sql as S
from .registration import Registry

registry = Registry()
query = registry.query

WORD = "the"
VEC = S.VECTORIZED


def _match(*columns: str) -> str:
    return "(" + " OR ".join(f"coalesce(contains({S.fold(c)}, '{WORD}'), false)" for c in columns) + ")"


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return frames.doc(spark, d), frames.memory_ext(spark, d)


@query(S.with_(S.FULL, f"SELECT id, type, title, substring(content, 1, 500) AS preview, source_type, memory_type, confidence FROM defaulted WHERE status = 'active' AND {_match('title', 'content', 'metadata')} ORDER BY updated_at DESC, id LIMIT 50"))
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(*_both(spark, d), WORD)


@query(S.with_(S.FULL, f"SELECT id, type, title, substring(content, 1, 300) AS preview, source_type, memory_type, confidence FROM defaulted WHERE status = 'active' AND (type = 'session' AND source_type IN ('openclaw_session', 'openclaw') OR type = 'memory' AND source_type = 'codex') AND {_match('title', 'content', 'metadata')} ORDER BY updated_at DESC, id LIMIT 5"))
def search_by_source(spark: SparkSession, d: str) -> DataFrame:
    return search.search(*_both(spark, d), WORD, "openclaw_session,codex", limit=5, preview=300)


@query(S.with_(S.FULL, "SELECT id, title, substring(content, 1, 200) AS preview, source_type, memory_type, scope, confidence, visibility FROM defaulted WHERE status = 'active' AND type = 'memory' ORDER BY updated_at DESC, id LIMIT 100"))
def list_memory(spark: SparkSession, d: str) -> DataFrame:
    return search.listed(*_both(spark, d), None)


@query(S.with_(S.FULL, "SELECT id, title, substring(content, 1, 200) AS preview, source_type, memory_type, scope, confidence, visibility FROM defaulted WHERE status = 'active' AND type = 'knowledge' ORDER BY updated_at DESC, id LIMIT 20 OFFSET 40"))
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return search.listed(*_both(spark, d), "knowledge", limit=20, offset=40)


@query(S.with_(S.FULL, "SELECT id, type, memory_type, scope, confidence, visibility FROM defaulted"))
def doc_with_ext(spark: SparkSession, d: str) -> DataFrame:
    return search.with_memory_defaults(*_both(spark, d)).select("id", "type", "memory_type", "scope", "confidence", "visibility")


@query(S.with_(S.DOC, f"SELECT id, type, source_type FROM doc WHERE status = 'active' AND NOT {VEC}"))
def pending_vectorize(spark: SparkSession, d: str) -> DataFrame:
    return frames.doc(spark, d).where((F.col("status") == "active") & ~parse.is_vectorized(F.col("metadata"))).select("id", "type", "source_type")


@query(S.with_(S.DOC, "SELECT id, array_to_string(list_filter(['Potential API key detected', 'Potential password detected', 'Private key detected'], lambda x: x = 'Potential API key detected' AND (contains(content, 'sk-') OR contains(content, 'api_key=')) OR x = 'Potential password detected' AND (contains(content, 'password=') OR contains(content, 'passwd=')) OR x = 'Private key detected' AND contains(content, '-----BEGIN')), ';') AS findings, NOT (contains(content, 'sk-') OR contains(content, 'api_key=') OR contains(content, 'password=') OR contains(content, 'passwd=') OR contains(content, '-----BEGIN')) AS passed FROM doc"))
def policy_check(spark: SparkSession, d: str) -> DataFrame:
    found = parse.findings(F.col("content"))
    return frames.doc(spark, d).select("id", F.array_join(found, ";").alias("findings"), (F.size(found) == 0).alias("passed"))


# ---------------------------------------------------------------- counts


@query(S.with_(S.DOC, f"SELECT source_type, count(*) AS total, count(*) FILTER ({VEC}) AS embedded FROM doc WHERE type = 'memory' AND status = 'active' GROUP BY source_type"))
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_source(frames.doc(spark, d), "memory")


@query(S.with_(S.DOC, f"SELECT source_type, count(*) AS total, count(*) FILTER ({VEC}) AS embedded FROM doc WHERE type = 'session' AND status = 'active' GROUP BY source_type"))
def session_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_source(frames.doc(spark, d), "session")


@query(S.with_(S.DOC, f"SELECT count(*) AS total, count(*) FILTER ({VEC}) AS embedded, count(*) FILTER (NOT {VEC}) AS pending FROM doc WHERE type = 'knowledge' AND status = 'active'"))
def knowledge_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.knowledge_stats(frames.knowledge(spark, d))


_PAIRS = ", ".join(f"count(*) FILTER (type = '{k}' AND status = '{s}') AS {k}_{s}" for k in ("knowledge", "memory", "session") for s in ("active", "archived", "deleted"))
_EMBEDDED = ", ".join(f"count(*) FILTER (type = '{k}' AND status = 'active' AND {VEC}) AS {k}_embedded" for k in ("knowledge", "memory", "session"))


@query(S.with_(S.DOC, f"SELECT {_PAIRS}, {_EMBEDDED}, count(*) AS total, round(sum(strlen(content)) / (1024 * 1024), 2) AS content_mb FROM doc"))
def data_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.data_stats(frames.doc(spark, d))


@query(S.with_(S.DOC, "SELECT type, status, count(*) AS n FROM doc GROUP BY type, status"))
def type_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return frames.doc(spark, d).groupBy("type", "status").agg(F.count("*").alias("n"))


@query(S.with_(S.DOC, f"SELECT type, count(*) AS total, count(*) FILTER ({VEC}) AS embedded, max(updated_at) AS updated_at, round(least(100.0, count(*) FILTER ({VEC}) / count(*) * 100)::DOUBLE, 2) AS percent FROM doc WHERE status = 'active' GROUP BY type"))
def progress_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.progress(frames.doc(spark, d))


@query(S.with_(S.DOC, f"SELECT coalesce(type, 'all') AS type, count(*) AS total, count(*) FILTER ({VEC}) AS embedded, round(count(*) FILTER ({VEC}) / count(*) * 100)::BIGINT AS percent FROM doc WHERE status = 'active' GROUP BY ROLLUP (type)"))
def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(frames.doc(spark, d))


@query(S.with_(S.DOC, "SELECT agent, memories, sessions, round(memories / (memories + sessions) * 100, 2) AS memory_percent FROM (SELECT regexp_replace(source_type, '_session$', '') AS agent, count(*) FILTER (type = 'memory') AS memories, count(*) FILTER (type = 'session') AS sessions FROM doc WHERE status = 'active' AND type <> 'knowledge' GROUP BY 1)"))
def agent_activity(spark: SparkSession, d: str) -> DataFrame:
    return stats.agent_activity(frames.doc(spark, d))


@query(S.with_(S.DOC, "SELECT source_type, sum(n)::BIGINT AS n FROM (SELECT source_type, count(*) AS n FROM sessions GROUP BY 1 UNION ALL SELECT source_type, count(*) FROM memories GROUP BY 1) GROUP BY source_type"))
def merge_source_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df: df.groupBy("source_type").agg(F.count("*").alias("n"))
    return stats.merged_counts(one(frames.sessions(spark, d)), one(frames.memories(spark, d)))


@query(S.with_(S.FULL, "SELECT memory_type, count(*) AS n, min(updated_at) AS oldest, max(updated_at) AS newest FROM defaulted WHERE type = 'memory' GROUP BY memory_type"))
def group_by_category(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_memory_defaults(frames.memories(spark, d), frames.memory_ext(spark, d))
    return stats.grouped(rows, "memory_type")


@query("SELECT conv_id, count(*) AS message_count FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def session_message_count(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.count("*").alias("message_count"))


# ---------------------------------------------------------------- ranking and context

_RANKED = f"SELECT *, CASE WHEN type = 'knowledge' THEN 0 ELSE 1 END AS first FROM defaulted WHERE status = 'active' AND {_match('title', 'content', 'metadata')} ORDER BY first, confidence DESC, updated_at DESC, id"


@query(S.with_(S.FULL, f"SELECT id, type, confidence, updated_at FROM ({_RANKED} LIMIT 20)"))
def context_rank(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(*_both(spark, d), WORD, 20).select("id", "type", "confidence", "updated_at")


_LABEL = "CASE WHEN source_type = 'knowledge' THEN '📚 知识库' WHEN source_type IN ('hermes', 'hermes_session') THEN '🤖 Hermes' WHEN source_type IN ('openclaw', 'openclaw_session') THEN '🐾 OpenClaw' WHEN source_type IN ('codex', 'codex_session') THEN '💻 Codex' WHEN source_type IN ('gemini', 'gemini_session') THEN '✨ Gemini' WHEN source_type = 'agent' THEN '🤖 Agent' WHEN source_type = 'manual' THEN '📝 手动' ELSE '📄 其他' END"


@query(S.with_(S.FULL, f"SELECT id, title, preview, type, label, confidence FROM (SELECT *, substring(content, 1, 500) AS preview, {_LABEL} AS label, row_number() OVER (PARTITION BY source_path ORDER BY first, confidence DESC, updated_at DESC, id) AS place FROM ({_RANKED} LIMIT 20)) WHERE coalesce(source_path, '') = '' OR place = 1 ORDER BY first, confidence DESC, updated_at DESC, id LIMIT 10"))
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return search.context_pack(*_both(spark, d), WORD, 10)


@query(S.with_(S.FULL, f"SELECT CASE WHEN count(*) = 0 THEN 0.0 WHEN bool_or(type = 'knowledge') THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence, count(*) AS n FROM ({_RANKED} LIMIT 10)"))
def context_confidence(spark: SparkSession, d: str) -> DataFrame:
    return search.context_confidence(search.context_pack(*_both(spark, d), WORD, 10))


@query(S.with_(S.FULL, f"SELECT id, type, preview FROM (SELECT id, type, substring(content, 1, 500) AS preview FROM defaulted WHERE status = 'active' AND type = 'knowledge' AND {_match('title', 'content')} ORDER BY updated_at DESC, id LIMIT 5) UNION ALL SELECT id, type, preview FROM (SELECT id, type, substring(content, 1, 500) AS preview FROM defaulted WHERE status = 'active' AND type = 'memory' AND source_type = 'codex' AND {_match('title', 'content')} ORDER BY updated_at DESC, id LIMIT 5)"))
def tool_context(spark: SparkSession, d: str) -> DataFrame:
    active = frames.doc(spark, d).where((F.col("status") == "active") & search.matches(WORD, "title", "content"))
    part = lambda c: active.where(c).orderBy(F.desc("updated_at"), "id").limit(5).select("id", "type", F.substring("content", 1, 500).alias("preview"))
    return part(F.col("type") == "knowledge").unionByName(part((F.col("type") == "memory") & (F.col("source_type") == "codex")))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.table(spark, d, "embeddings")
    return vector.top_k_of(rows, rows.where("vec_id = 0"), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.table(spark, d, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


# ---------------------------------------------------------------- labels of texts and paths

_TASK = "text || CASE doc_id % 6 WHEN 0 THEN ' Design' WHEN 1 THEN ' implement' WHEN 2 THEN ' 测试' WHEN 3 THEN ' deploy SMB' WHEN 4 THEN ' fix delete password' ELSE '' END"


@query(f"SELECT doc_id, CASE WHEN contains(t, '设计') OR contains(t, 'design') THEN 'technical_design' WHEN contains(t, '实现') OR contains(t, 'implement') THEN 'implementation' WHEN contains(t, '测试') OR contains(t, 'test') THEN 'testing' WHEN contains(t, '部署') OR contains(t, 'deploy') THEN 'deployment' WHEN contains(t, '修复') OR contains(t, 'fix') OR contains(t, 'bug') THEN 'bugfix' ELSE 'general' END AS intent FROM (SELECT doc_id, lower({_TASK}) AS t FROM documents)")
def detect_intent(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("doc_id", parse.intent(F.col("task")).alias("intent"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    tail = F.expr("case doc_id % 6 when 0 then ' Design' when 1 then ' implement' when 2 then ' 测试' when 3 then ' deploy SMB' when 4 then ' fix delete password' else '' end")
    return frames.table(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("task"))


@query(f"SELECT doc_id, concat_ws('|', CASE WHEN contains(t, 'SMB') OR contains(t, 'smb') THEN 'SMB文件监听可能漏报，必须使用定时扫描兜底' END, CASE WHEN contains(t, '删除') OR contains(t, 'delete') THEN '删除操作请注意数据备份' END, CASE WHEN contains(t, '密码') OR contains(t, 'password') OR contains(t, 'secret') THEN '涉及敏感信息，请使用 policy.check 工具检查' END) AS warnings FROM (SELECT doc_id, {_TASK} AS t FROM documents)")
def task_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("doc_id", F.array_join(parse.warnings(F.col("task")), "|").alias("warnings"))


@query(S.with_(S.DOC, f"SELECT id, {_LABEL} AS label FROM doc"))
def source_label(spark: SparkSession, d: str) -> DataFrame:
    return frames.doc(spark, d).select("id", parse.source_label(F.col("source_type")).alias("label"))


@query(S.with_(S.KNOWLEDGE, "SELECT id, regexp_extract(source_path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(source_path, '\\.([^./]*)$', 1)) AS extension, regexp_replace(source_path, '/?[^/]*$', '') AS parent FROM knowledge"))
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("source_path")
    return frames.knowledge(spark, d).select("id", parse.file_name(p).alias("name"), parse.stem(p).alias("stem"), parse.extension(p).alias("extension"), parse.parent(p).alias("parent"))


_TYPED = "['README', 'sop', 'style', 'template', 'case', 'notes', '背景', '模板'][doc_id % 8 + 1] || '_' || doc_id || '.md'"


@query(f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'project_background' WHEN 6 THEN 'project_background' WHEN 1 THEN 'sop' WHEN 2 THEN 'rules_standards' WHEN 3 THEN 'template' WHEN 7 THEN 'template' WHEN 4 THEN 'case_library' ELSE 'semantic' END AS memory_type FROM (SELECT doc_id, {_TYPED} AS name FROM documents)")
def infer_memory_type(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("concat(element_at(array('README', 'sop', 'style', 'template', 'case', 'notes', '背景', '模板'), cast(doc_id % 8 as int) + 1), '_', doc_id, '.md')")
    return frames.table(spark, d, "documents").select("doc_id", parse.memory_type(F.concat(F.lit("/kb/"), name)).alias("memory_type"))


@query("SELECT page_id, regexp_matches(lower(regexp_extract(url, '([^/]*)$', 1)), '[^.]\\.(html|htm|md|txt)$') AS supported FROM pages")
def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "pages").select("page_id", parse.is_supported_file(F.col("url")).alias("supported"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.convert import html_frame

    return html_frame(frames.table(spark, d, "pages"))


@query(S.with_(S.DOC, "SELECT id, sha256(content) AS content_hash FROM doc"))
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return frames.doc(spark, d).select("id", parse.content_hash(F.col("content")).alias("content_hash"))


@query(S.with_(S.DOC, "SELECT id, sha256(concat_ws(':', source_type, source_path, title)) AS stable_id FROM doc"))
def deterministic_id(spark: SparkSession, d: str) -> DataFrame:
    return frames.doc(spark, d).select("id", parse.deterministic_id(F.col("source_type"), F.col("source_path"), F.col("title")).alias("stable_id"))


@query(S.with_(S.DOC, "SELECT id, CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN days || ' days ago' ELSE strftime(updated_at, '%Y-%m-%d') END AS bucket FROM (SELECT id, updated_at, CAST(floor(epoch(TIMESTAMP '2024-01-21 12:00:00' - updated_at) / 86400) AS BIGINT) AS days FROM doc)"))
def date_bucket(spark: SparkSession, d: str) -> DataFrame:
    return frames.doc(spark, d).select("id", parse.age_bucket(F.col("updated_at"), F.expr("timestamp_ntz'2024-01-21 12:00:00'")).alias("bucket"))


@query("SELECT doc_id, chunk_no, substring(text, chunk_no * 400 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 101) // 400 + 1)) AS chunk_no FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(parse.fixed_chunks(F.col("text"), 500, 100)).alias("place", "chunk")).select("doc_id", F.col("place").cast("long").alias("chunk_no"), "chunk")


@query()
def chunk_paragraph(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.table(spark, d, "documents")
    wide = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return docs.select("doc_id", F.posexplode(parse.paragraph_chunks(wide, 800)).alias("place", "chunk")).select("doc_id", F.col("place").cast("long").alias("chunk_no"), "chunk")


# ---------------------------------------------------------------- export and import

_CSV = " || ',' || ".join("CASE WHEN regexp_matches({0}, '[,\"\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END".format(c) for c in ("id", "title", "content", "memory_type", "scope"))


@query(S.with_(S.FULL, f"SELECT id, {_CSV} || ',' || CASE WHEN metadata = '[\"note\"]' THEN 'note' ELSE '' END || ',' || printf('%.2f', confidence) AS line FROM defaulted WHERE type = 'memory'"))
def export_csv_line(spark: SparkSession, d: str) -> DataFrame:
    return exchange.csv_line(search.with_memory_defaults(frames.memories(spark, d), frames.memory_ext(spark, d)))


_QUOTED = " || ',' || ".join(f"'\"' || replace({c}, '\"', '\"\"') || '\"'" for c in ("id", "title", "content"))


@query(S.with_(S.FULL.replace("'private'", "'shared'"), f"SELECT id, {_QUOTED} AS line, visibility, updated_at FROM defaulted WHERE status = 'active'"))
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_memory_defaults(*_both(spark, d), visibility="shared").where("status = 'active'")
    line = F.concat_ws(",", *(exchange.quoted(F.col(c)) for c in ("id", "title", "content")))
    return rows.select("id", line.alias("line"), "visibility", "updated_at")


@query(S.with_(S.FULL, "SELECT id FROM defaulted WHERE source_type IN ('codex', 'manual') AND memory_type IN ('semantic', 'decision') AND type <> 'session'"))
def export_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_memory_defaults(*_both(spark, d))
    return exchange.export_filter(rows, ["codex", "manual"], ["semantic", "decision"], activity=False).select("id")


@query(S.with_(S.FULL, "SELECT DISTINCT memory_type, 0 AS place, NULL::VARCHAR AS title, NULL::VARCHAR AS id, '# ' || memory_type AS block FROM defaulted WHERE type = 'memory' UNION ALL SELECT memory_type, 1, title, id, '## ' || title || chr(10) || chr(10) || content FROM defaulted WHERE type = 'memory'"))
def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    return exchange.markdown_sections(search.with_memory_defaults(frames.memories(spark, d), frames.memory_ext(spark, d)))


@query(S.with_(S.FULL, "SELECT id, title, content, memory_type, scope, visibility, confidence, 'manual' AS source_type FROM defaulted WHERE type = 'memory'"))
def import_export_json(spark: SparkSession, d: str) -> DataFrame:
    rows = exchange.json_document(search.with_memory_defaults(frames.memories(spark, d), frames.memory_ext(spark, d)))
    return exchange.imported(rows.select(F.concat(F.lit('{"schema_version":"2.0","agent_id":"a","memories":['), "json", F.lit("]}")).alias("json")))


@query("SELECT item_id, title, text AS content, 'semantic' AS proposed_type, 'project' AS proposed_scope, confidence, review_status FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN substring(text, 1, 50) ELSE 'item ' || item_id END AS title, text, CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence, 'needs_review' AS review_status FROM benchmark)")
def ingest_candidates(spark: SparkSession, d: str) -> DataFrame:
    items = frames.table(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.expr("case when item_id % 3 = 0 then '' else concat('item ', item_id) end").alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("scope"), F.expr("case when item_id % 2 = 0 then null else 0.7D end").alias("confidence"), F.lit("a").alias("agent_id"),
    )
    return exchange.candidates(items).select(F.col("id").alias("item_id"), "title", "content", "proposed_type", "proposed_scope", "confidence", "review_status")


@query("SELECT item_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''), '|') AS tags FROM benchmark")
def csv_tags_parse(spark: SparkSession, d: str) -> DataFrame:
    return frames.table(spark, d, "benchmark").select("item_id", F.array_join(parse.csv_tags(F.col("text")), "|").alias("tags"))


@query(S.with_(S.DOC, "SELECT id, CASE WHEN metadata = '[\"note\"]' THEN 'note,a,b' ELSE 'a,b' END AS tags FROM memories"))
def tag_union(spark: SparkSession, d: str) -> DataFrame:
    both = F.array_union(parse.tags(F.col("metadata")), F.array(F.lit("a"), F.lit("b")))
    return frames.memories(spark, d).select("id", F.array_join(both, ",").alias("tags"))


@query("SELECT item_id, 'title ' || item_id AS title, text AS body FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'note_0' AS title, replace(text, ':', ';') AS body FROM benchmark WHERE item_id % 2 = 1")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    content = F.expr("case when item_id % 2 = 0 then concat(' § title ', item_id, ' : ', text, ' §  ') else replace(text, ':', ';') end")
    found = exchange.section_memories(frames.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), content.alias("content")), "note")
    return found.select(F.col("id").alias("item_id"), "title", "body")


@query(S.with_(S.SESSIONS, "SELECT conv_id, content FROM session_text"))
def session_assemble(spark: SparkSession, d: str) -> DataFrame:
    return frames.session_text(spark, d)


@query("SELECT conv_id, sum(length(text)) FILTER (role = 'user')::BIGINT AS tokens_in, sum(length(text)) FILTER (role <> 'user')::BIGINT AS tokens_out FROM conversations GROUP BY conv_id")
def session_token_totals(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sessions import typed_lines

    turns = frames.table(spark, d, "conversations")
    role = F.when(F.col("role") == "user", "user").otherwise("gemini")
    tokens = F.struct(F.when(F.col("role") == "user", F.char_length("text")).alias("input"), F.when(F.col("role") != "user", F.char_length("text")).alias("output"))
    rows = turns.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), F.to_json(F.struct(role.alias("type"), F.col("text").alias("content"), tokens.alias("tokens"))).alias("line"))
    out = typed_lines(rows)
    some = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return out.select(F.col("file").cast("long").alias("conv_id"), some("tokens_in"), some("tokens_out"))
