"""Queries that clean texts and judge them. Beside the documents they read a few literal texts of the kinds that the documents lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import stats
from ..sources import frames
from . import sql as S
from .registration import Registry

registry = Registry()
query = registry.query

#: Texts that the documents have no examples of; their ids are -1, -2, ...
CASES = (
    "\t\n \nfirst\n\nsecond\n\t \n\n \nthird\n\n", "go 東 京\tへ 1 春 夏秋  冬 end", "‎​one⁠two‮﻿", "  |   | |\n||\n| --- |\n  | : | - |\n| \t |x|\n|---|---", "abcd\nabcd\nabcde\n  abcde\t\nabcde\né é\né é\nabcde",
    "tool: nothing said", " note 7\nA\nnote 7\t\nB\n\tnote 7 \nnote\nnote\nC", "電話：  住所：\nroom:  floor: \nroom: 3 floor:\na: b: c", "\t tab  first\n 　 two　　words \n\n\t\t\nx\ty", "one\r\n\r\n two \t\r\nthree\r",
    "If nothing needs attention\nwell\n Current time: now\n\n\t\nDo not infer it\nDo not\nWhen reading HEARTBEAT.md in a workspace\nDo not read\nFollow it strictly", "---\nkey: v: w\n title : Own: name \nempty:\ntags: p ,q,, r\nno colon\n---\n\n# Name\nrest", "#  Spaced head \nx", "", "7", "RIFF data", "\u0001\u0002a\u0003b\u0004c",
)


def texts(spark: SparkSession, d: str) -> DataFrame:
    """id and content of documents and cases."""
    cases = spark.createDataFrame([(-1 - i, c) for i, c in enumerate(CASES)], "id long, content string")
    return frames.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).unionByName(cases)


def _literal(value: str) -> str:
    """A SQL string with everything but plain characters spelled out."""
    parts, plain = [], ""
    for c in value:
        if 32 <= ord(c) < 127:
            plain += c.replace("'", "''")
        else:
            parts += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
    return " || ".join([*parts, f"'{plain}'"])


_VALUES = ", ".join(f"({-1 - i}, {_literal(c)})" for i, c in enumerate(CASES))
TEXTS = f"texts AS (SELECT doc_id AS id, text AS content FROM documents UNION ALL SELECT * FROM (VALUES {_VALUES}) AS v(id, content))"
W = r"[ \t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CJK = text.CJK


def _trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{W}\n]+', ''), '{W}\n]+\z', '')"


def _unbroken(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\n\z', ''), '\r(\n|\z)', '\1', 'g')"


def _lines(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE string_split({_unbroken(x)}, chr(10)) END"


def _blank(x: str) -> str:
    return rf"CASE WHEN {x} = '' THEN '' ELSE regexp_replace({_unbroken(x)} || chr(10), '(?m)^(?:{W}]*\n)+', chr(10), 'g') END"


def _trailing(x: str) -> str:
    return rf"regexp_replace(regexp_replace({_unbroken(x)}, '{W}]+\n', chr(10), 'g'), '{W}]+\z', '')"


def _zero(x: str) -> str:
    return f"translate({x}, {' || '.join(f'chr({ord(c)})' for c in text.ZERO_WIDTH)}, '')"


def _adjacent(x: str) -> str:
    """``x`` is a column of lines."""
    return f"list_filter({x}, lambda line, i: NOT (i > 1 AND strlen({_trim('line')}) >= 5 AND {_trim('line')} = {_trim(f'{x}[i - 1]')}))"


def _closed(x: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, chr(10)) || chr(10) ELSE '' END"


def _cjk(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([{CJK}]) ([{CJK}])', '\1\2', 'g'), '([{CJK}]) ([{CJK}])', '\1\2', 'g')"


def _template(x: str) -> str:
    return rf"list_filter({x}, lambda line: NOT regexp_matches({_trim('line')}, '\A[^:：]*(?:[:：](?:{W}]|[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}\x{{2E80}}-\x{{2EFF}}\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FF19}}\x{{FF1B}}-\x{{FFEF}}])*){{2,}}\z'))"


def _spaces(x: str) -> str:
    return rf"list_transform({x}, lambda line: CASE WHEN {_trim('line')} = '' THEN '' ELSE regexp_extract(line, '\A{W}]*', 0) || regexp_replace({_trim('line')}, '{W}]+', ' ', 'g') END)"


def _table(x: str) -> str:
    return rf"list_filter({x}, lambda line: NOT (regexp_matches({_trim('line')}, '\A\|[|]*({W}]|\|)*\z') AND NOT contains(line, '---')))"


def _marks(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda line: {_trim('line')}), lambda t: t <> '' AND strlen(t) < 80)"


def _cleaned(sql: str) -> str:
    return S.with_(TEXTS, f"SELECT id, {sql} AS cleaned FROM texts")


def _by_line(sql: str) -> str:
    return S.with_(TEXTS, f"SELECT id, {sql} AS cleaned FROM (SELECT id, content, {_lines('content')} AS ls FROM texts)")


def _clean(spark: SparkSession, d: str, step) -> DataFrame:
    return texts(spark, d).select("id", step(F.col("content")).alias("cleaned"))


@query(_cleaned(_blank("content")))
def clean_blank_lines(spark, d):
    return _clean(spark, d, text.compress_blank_lines)


@query(_cleaned(_trailing("content")))
def clean_trailing(spark, d):
    return _clean(spark, d, text.trim_trailing)


@query(_cleaned(_zero("content")))
def clean_zero_width(spark, d):
    return _clean(spark, d, text.strip_zero_width)


@query(_cleaned(_cjk("content")))
def clean_cjk_spacing(spark, d):
    return _clean(spark, d, text.fix_cjk_spacing)


@query(_by_line(_closed(_adjacent("ls"))))
def dedup_adjacent_lines(spark, d):
    return _clean(spark, d, text.dedup_adjacent_lines)


_OFTEN = "list_filter(list_distinct(marks), lambda t: len(list_filter(marks, lambda u: u = t)) >= 3)"


@query(S.with_(TEXTS, f"SELECT id, CASE WHEN len(often) > 0 THEN array_to_string(list_filter(ls, lambda line: NOT list_contains(often, {_trim('line')})), chr(10)) ELSE content END AS cleaned FROM (SELECT id, content, ls, {_OFTEN} AS often FROM (SELECT id, content, ls, {_marks('ls')} AS marks FROM (SELECT id, content, {_lines('content')} AS ls FROM texts)))"))
def remove_watermarks(spark, d):
    return _clean(spark, d, text.remove_watermarks)


@query(S.with_(TEXTS, f"SELECT id, line, count(*) AS times FROM (SELECT id, {_trim('line')} AS line FROM (SELECT id, unnest({_lines('content')}) AS line FROM texts)) WHERE line <> '' AND strlen(line) < 80 GROUP BY id, line HAVING count(*) >= 3"))
def watermark_lines(spark, d):
    return stats.watermark_lines(texts(spark, d))


@query(_by_line(f"array_to_string({_template('ls')}, chr(10))"))
def remove_template_lines(spark, d):
    return _clean(spark, d, text.remove_template_lines)


@query(_by_line(f"array_to_string({_spaces('ls')}, chr(10))"))
def compress_spaces(spark, d):
    return _clean(spark, d, text.compress_spaces)


@query(_by_line(f"array_to_string({_table('ls')}, chr(10))"))
def filter_table_rows(spark, d):
    return _clean(spark, d, text.filter_table_rows)


@query()
def strip_heartbeat(spark, d):
    return _clean(spark, d, text.strip_heartbeat)


@query(_cleaned(_blank(f"({_zero(_trailing('content'))})")))
def clean_memory(spark, d):
    return _clean(spark, d, text.clean_memory)


@query()
def clean_knowledge(spark, d):
    return _clean(spark, d, text.clean_knowledge)


@query()
def clean_session(spark, d):
    return frames.session_text(spark, d).select("conv_id", text.clean_session(F.col("content")).alias("cleaned"))


@query(S.with_(TEXTS, f"SELECT id, strlen({_trim('content')}) < 50 AS tiny FROM texts"))
def tiny_docs(spark, d):
    return texts(spark, d).select("id", text.is_tiny(F.col("content")).alias("tiny"))


@query(S.with_(TEXTS, rf"SELECT id, strlen(content) <= 50 AND NOT regexp_matches(content, '(?m)^{W}]*(?:assistant|gemini|codex|openclaw):') AS empty_session FROM texts"))
def empty_sessions(spark, d):
    return texts(spark, d).select("id", text.is_empty_session(F.col("content")).alias("empty_session"))


_MARKED = " OR ".join(f"contains(content, '{m}')" for m in text.BINARY_MARKERS)


@query(S.with_(TEXTS, rf"SELECT id, content <> '' AND NOT ({_MARKED}) AND (len(regexp_extract_all(content, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}]')) > 10 OR len(regexp_extract_all(content, '[A-Za-z]+')) > 5) AS readable FROM texts"))
def readable_text(spark, d):
    return texts(spark, d).select("id", text.is_readable(F.col("content")).alias("readable"))


_SPECIAL = r"[^\x20-\x7E\x{4E00}-\x{9FFF}\x{3000}-\x{303F}]"


@query(S.with_(TEXTS, rf"SELECT id, content = '' OR len(regexp_extract_all(content, '{_SPECIAL}')) / greatest(length(content), 1) > 0.3 OR regexp_matches(content, '{_SPECIAL}{{6}}') OR (len(regexp_extract_all(content, '[\x{{4E00}}-\x{{9FFF}}\x{{3000}}-\x{{303F}}]')) = 0 AND len(regexp_extract_all(content, '[\x20-\x7E]')) < 5) OR len(regexp_extract_all(content, '[\x{{E000}}-\x{{F8FF}}\x{{FFF0}}-\x{{FFFF}}\x{{2400}}-\x{{243F}}]')) / greatest(length(content), 1) > 0.2 AS garbage FROM texts"))
def binary_garbage(spark, d):
    return texts(spark, d).select("id", text.is_binary_garbage(F.col("content")).alias("garbage"))


_FRONT = r"'(?s)\A---(.*?)---(.*)\z'"


@query(S.with_(TEXTS, rf"SELECT id, regexp_matches(content, '(?s)\A---.*?---') AS found, CASE WHEN regexp_matches(content, '(?s)\A---.*?---') THEN {_trim(f'regexp_extract(content, {_FRONT}, 2)')} ELSE content END AS body, CASE WHEN regexp_matches(content, '(?s)\A---.*?---') THEN len(list_distinct(list_transform(list_filter(string_split(regexp_extract(content, {_FRONT}, 1), chr(10)), lambda x: contains(x, ':')), lambda x: trim(split_part(x, ':', 1))))) ELSE 0 END::BIGINT AS n_keys FROM texts"))
def frontmatter(spark, d):
    meta, body = parse.frontmatter(F.col("content"))
    return texts(spark, d).select("id", F.col("content").rlike(r"(?s)\A---.*?---").alias("found"), body.alias("body"), F.size(F.map_keys(meta)).cast("long").alias("n_keys"))


_HEADING = _trim(r"regexp_extract(body, '(?m)^[ \t]*# (.*)$', 1)")
_BODIES = rf"b AS (SELECT id, CASE WHEN found THEN {_trim(f'regexp_extract(content, {_FRONT}, 2)')} ELSE content END AS body, CASE WHEN found THEN regexp_extract(content, {_FRONT}, 1) ELSE '' END AS block FROM (SELECT *, regexp_matches(content, '(?s)\A---.*?---') AS found FROM texts))"


@query(S.with_(f"{TEXTS}, {_BODIES}", rf"SELECT id, CASE WHEN regexp_matches(block, '(?m)^\s*title\s*:') THEN {_trim(r"regexp_extract(block, '(?m)^\s*title\s*:(.*)$', 1)")} WHEN regexp_matches(body, '(?m)^[ \t]*# ') THEN {_HEADING} ELSE 'file_' || id END AS title FROM b"))
def extract_title(spark, d):
    meta, body = parse.frontmatter(F.col("content"))
    return texts(spark, d).select("id", parse.title(meta, body, F.expr("concat('/kb/file_', id, '.md')")).alias("title"))


@query(S.with_(S.DOC, "SELECT id, title FROM sessions"))
def clean_session_title(spark, d):
    noisy = F.concat("title", F.repeat(F.lit(" (12in/34out tokens) "), F.pmod(F.crc32("id"), F.lit(9)).cast("int")))
    return frames.sessions(spark, d).select("id", text.strip_token_stats(noisy).alias("title"))


@query(r"SELECT doc_id, CASE WHEN trim(text, E' \t\r\n') = '' THEN CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || 'more' ELSE 'zzqq xxww' END WHEN doc_id % 2 = 0 THEN text || chr(10) || 'more' ELSE text || chr(10) || chr(10) || 'zzqq xxww' END AS merged FROM documents")
def text_merge(spark, d):
    docs = frames.table(spark, d, "documents")
    return docs.select("doc_id", text.merge_texts(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nmore"))).otherwise("zzqq xxww")).alias("merged"))


@query(S.with_(S.KNOWLEDGE, f"SELECT id, {_blank('(' + _zero(_trailing('content')) + ')')} AS cleaned FROM knowledge WHERE status = 'active' AND {_blank('(' + _zero(_trailing('content')) + ')')} <> content"))
def reclean_delta(spark, d):
    rows = frames.knowledge(spark, d).where("status = 'active'").withColumn("cleaned", text.clean_memory(F.col("content")))
    return rows.where("cleaned <> content").select("id", "cleaned")
