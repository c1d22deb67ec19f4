"""Agents' session logs, one reader per layout, from lines of JSON: file, line_no, line. Each gives one row per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_session, is_empty_session, strip_token_stats

SESSION = "file string, session_id string, model string, content string, message_count long"
SPOKEN = ("user", "assistant")


def _dialogue(messages: DataFrame) -> DataFrame:
    """Messages (file, line_no, role, text, model, session_id) to sessions; the first model and id that are given hold."""
    said = F.filter(F.array_sort(F.collect_list(F.struct("line_no", "role", "text"))), lambda m: m["text"].isNotNull() & (F.trim(m["text"]) != "") & m["role"].isNotNull())
    grouped = messages.groupBy("file").agg(said.alias("said"), _first("session_id"), _first("model"))
    text = F.array_join(F.transform("said", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return grouped.select("file", "session_id", "model", text.alias("content"), F.size("said").cast("long").alias("message_count")).where("message_count > 0")


def _first(column: str) -> Column:
    return F.try_element_at(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line_no", column))), lambda x: x[column].isNotNull() & (x[column] != "")), lambda x: x[column]), F.lit(1)).alias(column)


def _text_of(raw: Column) -> Column:
    """A JSON string, or the texts of a JSON array's parts (text, else content) joined by a space."""
    parts = F.from_json(raw, "array<struct<text:string,content:string,type:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: F.coalesce(p["text"], p["content"])), lambda x: x.isNotNull()), " ")
    return F.when(raw.startswith("["), joined).otherwise(raw)


def _is_tool(text: Column) -> Column:
    return text.startswith("tool_call:") | text.startswith("```tool")


def message_lists(files: DataFrame) -> DataFrame:
    """One JSON object per file (column content): session_id, model, messages with a role and a text or a list of parts."""
    kind = "struct<session_id:string,model:string,messages:array<struct<role:string,content:string>>>"
    found = files.select("file", F.from_json("content", kind).alias("s")).select("file", "s.session_id", "s.model", F.posexplode("s.messages").alias("line_no", "m"))
    rows = found.select("file", "line_no", "session_id", "model", F.when(F.col("m.role").isin(*SPOKEN), F.col("m.role")).alias("role"), _text_of(F.col("m.content")).alias("text"))
    return _dialogue(rows.withColumn("text", F.when(~_is_tool(F.col("text")), F.col("text"))))


def typed_lines(lines: DataFrame) -> DataFrame:
    """Lines {type: user or gemini, content, model, tokens, thoughts}: sessions with sums of tokens."""
    kind = "struct<type:string,content:string,model:string,tokens:struct<input:bigint,output:bigint>,thoughts:array<struct<text:string>>>"
    found = lines.select("file", "line_no", F.from_json("line", kind).alias("j")).select("file", "line_no", "j.*")
    thought = F.when(F.size("thoughts") > 0, F.concat(F.lit("[thoughts] "), F.array_join(F.transform("thoughts", lambda t: t["text"]), " "), F.lit("\n"))).otherwise("")
    role = F.when(F.col("type") == "user", "user").when(F.col("type") == "gemini", "gemini")
    said = _dialogue(found.select("file", "line_no", role.alias("role"), F.concat(thought, _text_of(F.col("content"))).alias("text"), F.lit(None).cast("string").alias("session_id"), "model"))
    totals = found.groupBy("file").agg(F.coalesce(F.sum("tokens.input"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens.output"), F.lit(0)).alias("tokens_out"))
    return said.join(totals, "file", "left")


def payload_lines(lines: DataFrame) -> DataFrame:
    """Lines {type, payload}: event_msg is what the user said, response_item of type message what was answered; the folder's name is the title."""
    kind = "struct<type:string,payload:struct<id:string,type:string,message:string,role:string,cwd:string,content:string>>"
    found = lines.select("file", "line_no", F.from_json("line", kind).alias("j")).select("file", "line_no", "j.type", "j.payload")
    user, answer = F.col("type") == "event_msg", (F.col("type") == "response_item") & (F.col("payload.type") == "message")
    rows = found.select(
        "file", "line_no", F.when(user, "user").when(answer, "codex").alias("role"), F.when(user, F.col("payload.message")).when(answer, _text_of(F.col("payload.content"))).alias("text"),
        F.when(F.col("type") == "session_meta", F.regexp_extract("payload.cwd", r"[^/\\]+$", 0)).alias("session_id"), F.lit(None).cast("string").alias("model"),
    )
    return _dialogue(rows)


def message_lines(lines: DataFrame) -> DataFrame:
    """Lines {type: message, message: {role, content: parts}}: only parts of type text count."""
    kind = "struct<type:string,message:struct<role:string,content:array<struct<type:string,text:string>>>>"
    found = lines.select("file", "line_no", F.from_json("line", kind).alias("j")).where("j.type = 'message'")
    text = F.array_join(F.transform(F.filter("j.message.content", lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    none = F.lit(None).cast("string")
    return _dialogue(found.select("file", "line_no", F.when(F.col("j.message.role").isin(*SPOKEN), F.col("j.message.role")).alias("role"), text.alias("text"), none.alias("session_id"), none.alias("model")))


def cleaned(sessions: DataFrame) -> DataFrame:
    """Sessions worth keeping: not empty, cleaned, with a title of the id (or the file's name) and the model."""
    title = F.concat(F.coalesce("session_id", F.regexp_extract("file", r"([^/\\]*?)(\.[^.]*)?$", 1)), F.coalesce(F.concat(F.lit(" ["), F.col("model"), F.lit("]")), F.lit("")))
    return sessions.where(~is_empty_session(F.col("content"))).withColumn("title", strip_token_stats(title)).withColumn("content", clean_session(F.col("content")))


def read_lines(spark, path: str) -> DataFrame:
    """Files of JSON lines below a folder: file, line_no, line. Files are read whole, so that lines keep their order."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
