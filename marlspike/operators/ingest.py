"""What agents and collectors hand in, as rows that are accepted or rejected with reasons.

Requests (request_id, json) are validated as a whole against the outer schema and part by part against the inner one: a
bad part doesn't take the others with it. Nothing is lost: each part is one row, with ``violations``; accepted ones have
none. Ids are digests of the request and the part's place, so that a request that is sent again gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from . import schemas

_TEXT, _FILLED = {"type": "string"}, {"type": "string", "minLength": 1}
#: Fixed names and kinds of fields of the requests.
FILE_EVENT = {
    "type": "object", "required": ["event_id", "data_source_id", "event_type", "path"],
    "properties": {"event_id": _FILLED, "data_source_id": _TEXT, "event_type": _TEXT, "path": _FILLED, "size_bytes": {"type": ["integer", "null"], "minimum": 0}, "mtime": {"type": ["string", "null"]}, "sha256": {"type": ["string", "null"], "pattern": "^[a-f0-9]{64}$"}},
}
ARTIFACT = {"type": "object", "properties": {"title": _TEXT, "type": _TEXT, "artifact_type": _TEXT, "content": {"type": ["string", "null"]}, "mime_type": {"type": ["string", "null"]}}}
MEMORY = {"type": "object", "properties": {"title": _TEXT, "type": _TEXT, "scope": _TEXT, "content": _TEXT, "reason": _TEXT, "confidence": {"type": "number", "minimum": 0, "maximum": 1}}}


def _parts(requests: DataFrame, field: str, rule: dict, single: bool = False, needed: tuple[str, ...] = ()) -> DataFrame:
    """request_id, place, id, device_id, agent_id, listed, part (JSON) and violations of each part.

    A request that is wrong as a whole is one row with itself as the part; one without parts gives no row.
    """
    outer = {"type": "object", "required": [*needed, *([] if single else [field])], "properties": {n: _TEXT for n in needed} | {field: {"type": "array"}}}
    parsed = F.try_parse_json("json")
    listed = F.try_variant_get(parsed, f"$.{field}", "array<variant>")
    wrong = schemas.violations(F.col("json"), outer)
    own = lambda name: F.try_variant_get(parsed, f"$.{name}", "string").alias(name)
    rows = requests.select("request_id", "json", wrong.alias("wrong"), listed.alias("listed"), own("device_id"), own("agent_id"))
    parts = F.transform("listed", lambda v: F.to_json(v))
    parts = F.when(F.size("wrong") > 0, F.array("json")).otherwise(F.coalesce(parts, F.array("json")) if single else parts)
    each = rows.select("request_id", "wrong", F.col("listed").isNotNull().alias("listed"), "device_id", "agent_id", F.posexplode(parts).alias("place", "part"))
    inner = F.when(F.size("wrong") > 0, F.col("wrong")).otherwise(schemas.violations(F.col("part"), rule))
    digest = F.sha2(F.concat_ws(":", F.lit(field), "request_id", F.col("place").cast("string")), 256)
    return each.select("request_id", "place", digest.alias("id"), "device_id", "agent_id", "listed", "part", inner.alias("violations"))


def _field(name: str) -> Column:
    return F.get_json_object("part", f"$.{name}")


def accepted(parts: DataFrame) -> DataFrame:
    return parts.where(F.size("violations") == 0)


def rejected(parts: DataFrame) -> DataFrame:
    """Rows that are kept with their reasons: request_id, place, part, violations."""
    return parts.where(F.size("violations") > 0).select("request_id", "place", "part", "violations")


def outcome(parts: DataFrame) -> DataFrame:
    """What a request is answered: request_id, place, id (an event's own one, if it has any) and whether it was accepted."""
    return parts.select("request_id", "place", F.coalesce(_field("event_id"), "id").alias("id"), (F.size("violations") == 0).alias("accepted"))


def file_event_parts(requests: DataFrame) -> DataFrame:
    return _parts(requests, "events", FILE_EVENT, needed=("device_id",))


def source_files(parts: DataFrame, now: Column) -> DataFrame:
    """The files of accepted events; of one event id the first by request and place counts."""
    first = Window.partitionBy("event_id").orderBy("request_id", "place")
    rows = accepted(parts).withColumn("event_id", _field("event_id")).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    path = _field("path")
    return rows.select(
        "id", "event_id", F.lit("default").alias("workspace_id"), "device_id", _field("data_source_id").alias("data_source_id"), path.alias("path"), F.lower(path).alias("normalized_path"),
        parse.file_name(path).alias("file_name"), F.nullif(F.regexp_extract(parse.file_name(path), r"^.+\.([^.]*)$", 1), F.lit("")).alias("extension"), _field("size_bytes").cast("long").alias("size_bytes"),
        _field("mtime").alias("mtime"), _field("sha256").alias("sha256"), F.lit("new").alias("status"), now.alias("created_at"), now.alias("updated_at"),
    )


def artifact_parts(requests: DataFrame) -> DataFrame:
    """A request is a list of artifacts or one artifact by itself."""
    return _parts(requests, "artifacts", ARTIFACT, single=True)


def artifacts(parts: DataFrame, now: Column) -> DataFrame:
    kind = F.when(F.col("listed"), _field("type")).otherwise(_field("artifact_type"))
    return accepted(parts).select(
        "id", F.lit("default").alias("workspace_id"), F.coalesce(_field("title"), F.lit("Untitled")).alias("title"), F.coalesce(kind, F.lit("document")).alias("artifact_type"), _field("content").alias("content"),
        _field("mime_type").alias("mime_type"), F.col("device_id").alias("source_device_id"), F.coalesce("agent_id", F.lit("unknown")).alias("source_agent_id"),
        F.when(_field("content").isNotNull(), F.sha2(_field("content"), 256)).alias("sha256"), F.lit("submitted").alias("status"), now.alias("created_at"), now.alias("updated_at"),
    )


def memory_parts(requests: DataFrame) -> DataFrame:
    return _parts(requests, "memories", MEMORY)


def candidates(parts: DataFrame, now: Column) -> DataFrame:
    return accepted(parts).select(
        "id", F.coalesce(_field("title"), F.lit("Untitled Memory")).alias("title"), F.coalesce(_field("content"), F.lit("")).alias("content"), F.coalesce(_field("type"), F.lit("semantic")).alias("proposed_type"),
        F.coalesce(_field("scope"), F.lit("project")).alias("proposed_scope"), F.coalesce(_field("confidence").cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce("agent_id", F.lit("unknown")).alias("source_agent_id"),
        F.lit("needs_review").alias("review_status"), now.alias("created_at"),
    )
