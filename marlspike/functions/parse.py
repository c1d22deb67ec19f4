"""Parsing and classifying texts, paths and titles, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

# File extensions, key words and labels, in the order in which they are tried.
EXTENSIONS = (
    "md", "txt", "markdown", "rst", "asciidoc", "adoc", "json", "yaml", "yml", "toml", "csv", "tsv", "xml", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "odt", "ods", "odp", "pdf",
    "html", "htm", "mhtml", "mht", "epub", "rtf", "ini", "cfg", "conf", "properties", "env", "sh", "bash", "zsh", "fish", "ps1", "bat", "cmd", "log", "sql", "graphql", "proto",
)
SKIPPED_FILES = ("memory.md", "user.md", "memory.md.lock", "user.md.lock")
MOST_FILE_BYTES = 10 * 1024 * 1024
TYPE_WORDS = (
    ("project_background", ("readme", "background", "intro", "overview", "项目背景", "背景")),
    ("sop", ("sop", "process", "guide", "workflow", "流程", "步骤", "deploy", "发布")),
    ("rules_standards", ("rule", "standard", "style", "规范", "标准", "规则", "convention", "约定")),
    ("template", ("template", "模板")),
    ("case_library", ("case", "example", "案例", "示例", "样本")),
)
INTENT_WORDS = (
    ("technical_design", ("设计", "design")), ("implementation", ("实现", "implement")), ("testing", ("测试", "test")), ("deployment", ("部署", "deploy")), ("bugfix", ("修复", "fix", "bug")),
)
WARNINGS = (
    (("SMB", "smb"), "SMB文件监听可能漏报，必须使用定时扫描兜底"),
    (("删除", "delete"), "删除操作请注意数据备份"),
    (("密码", "password", "secret"), "涉及敏感信息，请使用 policy.check 工具检查"),
)
SOURCE_LABELS = (
    (("knowledge",), "📚 知识库"), (("hermes", "hermes_session"), "🤖 Hermes"), (("openclaw", "openclaw_session"), "🐾 OpenClaw"), (("codex", "codex_session"), "💻 Codex"),
    (("gemini", "gemini_session"), "✨ Gemini"), (("agent",), "🤖 Agent"), (("manual",), "📝 手动"),
)
OTHER_LABEL = "📄 其他"
FINDINGS = (
    (("sk-", "api_key="), "Potential API key detected"), (("password=", "passwd="), "Potential password detected"), (("-----BEGIN",), "Private key detected"),
)
AGENT_PREFIXES = ("gemini", "codex", "hermes", "openclaw")
MEMORY_TYPES = ("project_background", "sop", "rules_standards", "template", "case_library", "decision", "preference", "semantic", "episodic", "procedural", "activity")
MEMORY_TYPE_ALIASES = {"style_guide": "rules_standards"}


def holds_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_rule(text: Column, rules, default: str) -> Column:
    """The name of the first rule of which the text holds a word."""
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(holds_any(text, words), name).otherwise(out)
    return out


def all_rules(text: Column, rules) -> Column:
    """The messages of all rules of which the text holds a word."""
    return F.array_compact(F.array(*(F.when(holds_any(text, words), message) for words, message in rules)))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def is_supported_file(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS) & ~F.lower(file_name(path)).isin(*SKIPPED_FILES)


def in_hidden_folder(path: Column) -> Column:
    return parent(path).rlike(r"(^|/)\.[^/.]")


def frontmatter(content: Column) -> tuple[Column, Column]:
    """Metadata (a map) and body. The block begins the text with --- and ends at the next --- anywhere."""
    found = content.rlike(r"(?s)\A---.*?---")
    block = F.regexp_extract(content, r"(?s)\A---(.*?)---(.*)\z", 1)
    pairs = F.filter(F.split(block, "\n"), lambda line: line.contains(":"))
    entry = lambda line: F.struct(trim(F.substring_index(line, ":", 1)).alias("key"), trim(F.regexp_replace(line, r"\A[^:]*:", "")).alias("value"))
    entries = F.transform(pairs, entry)
    # of a key that is given twice, the later value holds
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    meta = F.when(found, F.map_from_entries(last)).otherwise(F.map_from_entries(F.slice(entries, 1, 0)))
    return meta, F.when(found, trim(F.regexp_extract(content, r"(?s)\A---(.*?)---(.*)\z", 2))).otherwise(content)


def title(meta: Column, content: Column, path: Column) -> Column:
    """From the metadata, else the first heading, else the file's name."""
    heading = F.regexp_extract(content, r"(?m)^[ \t]*# (.*)$", 1)
    return F.coalesce(F.element_at(meta, "title"), F.when(content.rlike(r"(?m)^[ \t]*# "), trim(heading)), F.when(stem(path) != "", stem(path)), F.lit("Untitled"))


def csv_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), trim), lambda t: t != "")


def memory_type(path: Column) -> Column:
    return first_rule(F.lower(file_name(path)), TYPE_WORDS, "semantic")


def parse_memory_type(name: Column) -> Column:
    known = F.when(name.isin(*MEMORY_TYPES), name)
    for alias, meant in MEMORY_TYPE_ALIASES.items():
        known = F.when(name == alias, meant).otherwise(known)
    return F.coalesce(known, F.lit("semantic"))


def intent(task: Column) -> Column:
    return first_rule(F.lower(task), INTENT_WORDS, "general")


def warnings(task: Column) -> Column:
    return all_rules(task, WARNINGS)


def source_label(source_type: Column) -> Column:
    out = F.lit(OTHER_LABEL)
    for names, label in SOURCE_LABELS:
        out = F.when(source_type.isin(*names), label).otherwise(out)
    return out


#: Fixed: sources that are agents; all others belong to the category other.
AGENT_SOURCES = ("hermes", "codex", "gemini", "openclaw", "agent")


def source_category(source_type: Column) -> Column:
    """agent or other; sessions belong where their agent does."""
    return F.when(F.regexp_replace(source_type, "_session$", "").isin(*AGENT_SOURCES), "agent").otherwise("other")


def legacy_source(kind: Column, source_type: Column) -> Column:
    """The source by which older clients know a document."""
    return F.when(kind == "knowledge", "knowledge").otherwise(source_type)


def fingerprint(device: Column, system: Column) -> Column:
    return F.sha2(F.concat(device, F.lit(":"), system), 256)


def agent_id(name: Column) -> Column:
    lower = F.lower(name)
    out = lower
    for prefix in AGENT_PREFIXES:
        out = F.when(lower.startswith(prefix), prefix).otherwise(out)
    return out


def findings(content: Column) -> Column:
    return all_rules(content, FINDINGS)


def tags(metadata: Column) -> Column:
    """A JSON array of strings; anything else is no tags."""
    return F.coalesce(F.from_json(metadata, "array<string>"), F.array().cast("array<string>"))


def is_vectorized(metadata: Column) -> Column:
    """Whether tags have been written; never null."""
    return F.coalesce(~metadata.isin("", "{}", "[]"), F.lit(False))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def deterministic_id(source_type: Column, path: Column, name: Column) -> Column:
    return F.sha2(F.concat_ws(":", source_type, path, name), 256)


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Chunks of size characters, each beginning overlap characters before the last one's end; null for null."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(size - overlap))
    return F.when(n == 0, F.array().cast("array<string>")).when(n > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


def paragraph_chunks(text: Column, size: int) -> Column:
    """Paragraphs put together while their bytes fit; a longer one is a chunk of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, part: Column) -> Column:
        fits = (state["now"] == "") | (F.octet_length(state["now"]) + F.octet_length(part) <= size)
        more = F.when(state["now"] == "", part).otherwise(F.concat(state["now"], F.lit("\n\n"), part))
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(trim(state["now"])))).alias("done"), F.when(fits, more).otherwise(part).alias("now"))

    whole = F.aggregate(F.split(text, "\n\n"), empty, step, lambda s: F.when(trim(s["now"]) == "", s["done"]).otherwise(F.concat(s["done"], F.array(trim(s["now"])))))
    return whole


def utf8_prefix(text: Column, most_bytes: int) -> Column:
    """The longest prefix of at most so many bytes that ends with a whole character."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most_bytes)
    whole = F.regexp_replace(F.decode(cut, "ISO-8859-1"), r"(?:[\xC0-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF7][\x80-\xBF]{0,2})\z", "")
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))


def retry_delay(attempt: Column, base: int = 1, most: int = 60, retries: int = 3) -> Column:
    """Seconds before a retry: doubling up to a limit, and the limit once retries are used up."""
    return F.when(attempt >= retries, F.lit(most)).otherwise(F.least(F.lit(most).cast("double"), base * F.pow(F.lit(2.0), attempt))).cast("long")


def age_bucket(at: Column, now: Column) -> Column:
    days = F.floor(F.timestamp_diff("SECOND", at, now) / 86400)
    return F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))
