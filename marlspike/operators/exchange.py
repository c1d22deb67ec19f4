"""Export and import of memories, and what agents and services hand in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import trim

EXPORT = "struct<schema_version:string,agent_id:string,memories:array<struct<id:string,title:string,content:string,memory_type:string,scope:string,visibility:string,confidence:double,tags:array<string>,source:struct<source_type:string>,metadata:struct<confidence:double,visibility:string>>>>"


def quoted(text: Column) -> Column:
    """A CSV field, always in quotes."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def quoted_if_needed(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), quoted(text)).otherwise(text)


def csv_line(memories: DataFrame) -> DataFrame:
    """id and line: RFC 4180 fields, tags joined by semicolons, confidence with two decimals."""
    tags = F.array_join(parse.tags(F.col("metadata")), ";")
    fields = [F.col("id"), F.col("title"), F.col("content"), F.col("memory_type"), F.col("scope"), tags, F.format_string("%.2f", "confidence")]
    return memories.select("id", F.concat_ws(",", *map(quoted_if_needed, fields)).alias("line"))


SCHEMA_VERSION = "2.0"


def export_selection(memories: DataFrame, status: str = "active", ids: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """The rows that an export holds: of a status, and of the ids if there are any, else of a type if one is given."""
    rows = memories.where(F.col("status") == status)
    if ids:
        return rows.where(F.col("id").isin(ids))
    return rows.where(F.col("type") == kind) if kind else rows


def export_lines(memories: DataFrame) -> DataFrame:
    """id, line and updated_at: every text field in quotes, the confidence with two decimals."""
    fields = ("id", "title", "content", "memory_type", "scope", "source_type", "visibility", "status")
    return memories.select("id", F.concat_ws(",", *(quoted(F.col(c)) for c in fields), F.format_string("%.2f", "confidence")).alias("line"), "updated_at")


def json_document(memories: DataFrame) -> DataFrame:
    """One JSON object per memory, as in an export's list."""
    body = F.struct("id", "title", "content", "memory_type", "scope", "visibility", "confidence", parse.tags(F.col("metadata")).alias("tags"))
    return memories.select("id", F.to_json(body).alias("json"))


def export_items(memories: DataFrame) -> DataFrame:
    """One JSON object per memory with nested source and metadata, as export files hold them."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    source = F.struct(F.col("source_type"), F.col("source_path").alias("file_path"))
    about = F.struct("confidence", "visibility", "status")
    body = F.struct("id", "title", "content", "memory_type", "scope", parse.tags(F.col("metadata")).alias("tags"), source.alias("source"), about.alias("metadata"), text("updated_at").alias("updated_at"))
    return memories.select("id", F.to_json(body).alias("json"))


def write_export(items: DataFrame, path: str, export_id: str, exported_at: str, agent_id: str = "hub") -> dict:
    """Writes an export as parts of JSON lines and, last, its outer document; returns that document.

    The parts are written where the rows are; their number is observed in the same pass and put into the outer document
    (``path/export.json``), which names the folder of parts. An export without it is one that failed.
    """
    seen = Observation("export")
    items.observe(seen, F.count("*").alias("total_count")).select(F.col("json").alias("value")).write.text(f"{path}/memories")
    outer = {"schema_version": SCHEMA_VERSION, "export_id": export_id, "exported_at": exported_at, "workspace_id": "default", "agent_id": agent_id, "total_count": seen.get["total_count"], "memories": "memories"}
    items.sparkSession.createDataFrame([(json.dumps(outer),)], "value string").coalesce(1).write.text(f"{path}/export.json")
    return outer


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The memories of a written export, as imported() gives them; fails if there are not as many as the outer document says."""
    outer = json.loads(spark.read.text(f"{path}/export.json").first().value)
    if outer["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"version {outer['schema_version']} of exports isn't known")
    lines = spark.read.text(f"{path}/{outer['memories']}")
    if (found := lines.count()) != outer["total_count"]:
        raise ValueError(f"the export holds {found} memories of {outer['total_count']}")
    agent = F.lit(json.dumps(outer["agent_id"]))
    flat = F.concat(F.lit('{"schema_version":"2.0","agent_id":'), agent, F.lit(',"memories":['), "value", F.lit("]}"))
    return imported(lines.select(flat.alias("json")))


def markdown_sections(memories: DataFrame) -> DataFrame:
    """The blocks of a Markdown export, a row each: per memory type a heading (place 0), then its memories (place 1), to be read by type, place, title and id.

    No type is gathered in one value; sorted by these columns and written as text, the rows are the document.
    """
    item = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("content"))
    items = memories.select("memory_type", F.lit(1).alias("place"), "title", "id", item.alias("block"))
    none = F.lit(None).cast("string")
    heads = memories.select("memory_type").distinct().select("memory_type", F.lit(0).alias("place"), none.alias("title"), none.alias("id"), F.concat(F.lit("# "), F.col("memory_type")).alias("block"))
    return heads.unionByName(items)


def imported(exports: DataFrame) -> DataFrame:
    """Memories of export documents (column json); what is missing or unknown gets its default. Documents that are no JSON give none."""
    found = exports.select(F.from_json("json", EXPORT).alias("e")).select("e.agent_id", F.explode("e.memories").alias("m"))
    return found.select(
        "m.id", F.coalesce("m.title", F.substring("m.content", 1, 50)).alias("title"), F.coalesce("m.content", F.lit("")).alias("content"),
        parse.parse_memory_type(F.coalesce("m.memory_type", F.lit(""))).alias("memory_type"), F.coalesce("m.scope", F.lit("project")).alias("scope"),
        F.coalesce("m.visibility", "m.metadata.visibility", F.lit("private")).alias("visibility"), F.coalesce("m.confidence", "m.metadata.confidence", F.lit(0.8)).alias("confidence"), F.lit("manual").alias("source_type"),
    )


def export_filter(memories: DataFrame, source_types: list[str] | None = None, memory_types: list[str] | None = None, knowledge: bool = True, activity: bool = True) -> DataFrame:
    out = memories
    if source_types:
        out = out.where(F.col("source_type").isin(source_types))
    if memory_types:
        out = out.where(F.col("memory_type").isin(memory_types))
    if not knowledge:
        out = out.where("type <> 'knowledge'")
    if not activity:
        out = out.where("type <> 'session'")
    return out


def candidates(submitted: DataFrame) -> DataFrame:
    """Submitted memories as candidates for review: id, title, content, type, scope, confidence, agent; with defaults."""
    return submitted.select(
        "id", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.substring("content", 1, 50)).alias("title"), "content", F.coalesce("type", F.lit("semantic")).alias("proposed_type"),
        F.coalesce("scope", F.lit("project")).alias("proposed_scope"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.col("agent_id").alias("source_agent_id"),
        F.lit("needs_review").alias("review_status"),
    )


def section_memories(texts: DataFrame, category: str) -> DataFrame:
    """Sections between § signs: ``title: body`` if the part before the first colon is short and one line, else a numbered title."""
    parts = texts.select("id", F.posexplode(F.split("content", "§")).alias("place", "raw")).select("id", "place", trim(F.col("raw")).alias("section")).where("section <> ''")
    head = F.substring_index("section", ":", 1)
    named = F.col("section").contains(":") & (F.octet_length(head) < 50) & ~head.contains("\n")
    title = F.when(named, trim(head)).otherwise(F.concat(F.lit(f"{category}_"), F.col("place").cast("string")))
    return parts.select("id", "place", title.alias("title"), F.when(named, trim(F.regexp_replace("section", r"\A[^:]*:", ""))).otherwise(F.col("section")).alias("body"))


#: Fixed values of what each kind of activity becomes: type, scope, confidence, visibility.
ACTIVITIES = {
    "agent": ("episodic", "session", 0.8, "agent"), "decision": ("decision", "project", 0.9, "project"), "git": ("episodic", "project", 1.0, "project"),
    "browser": ("episodic", "session", 0.6, "private"), "chat": ("episodic", "session", 0.7, "private"), "preference": ("preference", "global", 1.0, "private"),
}


def activity_memories(events: DataFrame) -> DataFrame:
    """Activities (event_id, kind, title, content, detail, actor, tags) as memories, each kind with its texts, tags and constants.

    detail: a decision's reason, a commit's hash, a page's address, a chat's platform, a preference's value; actor: who
    committed, sent or decided.
    """
    kind, title, detail = F.col("kind"), F.coalesce("title", F.lit("")), F.coalesce("detail", F.lit(""))
    body = F.coalesce("content", F.lit(""))
    first_line = F.coalesce(F.nullif(F.split(title, "\n")[0], F.lit("")), F.lit("No message"))
    name = F.when(kind == "git", F.concat(F.lit("Git: "), first_line)).when(kind == "browser", F.concat(F.lit("浏览: "), title)).when(kind == "chat", F.concat(detail, F.lit(": "), F.coalesce("title", "actor"))).when(kind == "preference", F.concat(F.lit("偏好: "), title)).otherwise(title)
    text = (
        F.when(kind == "decision", F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n\n## 决策原因\n"), detail))
        .when(kind == "git", F.concat(F.lit("# Git Commit\n\n**Hash:** "), detail, F.lit("\n**Author:** "), F.coalesce("actor", F.lit("")), F.lit("\n**Message:**\n"), title, F.lit("\n\n**Files Changed:**\n"), body))
        .when(kind == "browser", F.concat(F.lit("# 浏览: "), title, F.lit("\n\n**URL:** "), detail, F.lit("\n\n"), body))
        .when(kind == "preference", F.concat(F.lit("# 偏好: "), title, F.lit("\n\n**值:** "), detail, F.lit("\n\n"), F.when(body != "", F.concat(F.lit("**上下文:**\n"), body)).otherwise(""))).otherwise(body)
    )
    own = F.coalesce("tags", F.array().cast("array<string>"))
    tags = F.when(kind == "git", F.array(F.lit("git"), F.lit("commit"))).when(kind == "browser", F.array(F.lit("browser"), F.lit("web"))).when(kind == "chat", F.array(detail, F.lit("chat"))).when(kind == "preference", F.array(F.lit("preference"), title)).otherwise(own)
    source = F.when(kind.isin("agent", "decision"), "agent").when(kind == "chat", F.when(detail.isin("wechat", "feishu"), detail).otherwise("manual")).when(kind == "preference", "manual").otherwise(kind)
    owner = F.when(kind.isin("git", "chat"), F.col("actor"))
    constant = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in ACTIVITIES.items() for x in (k, v[i]))), kind)
    return events.where(kind.isin(*ACTIVITIES)).select(
        "event_id", name.alias("title"), text.alias("content"), constant(0).alias("memory_type"), constant(1).alias("scope"), constant(2).alias("confidence"), constant(3).alias("visibility"),
        tags.alias("tags"), source.alias("source_type"), owner.alias("owner"),
    )
