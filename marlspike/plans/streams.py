"""Queries over events: the batch forms of what the streams compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import events as ops
from ..operators import lifecycle
from ..sources import frames
from . import sql as S
from .registration import Registry

registry = Registry()
query = registry.query

HOUR = 3600


@query(S.with_(S.FILE_EVENTS, f"""
, e AS (SELECT key, event_id, ts, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM file_events WHERE kind IS NOT NULL)
, r(key, n, event_id, ts, last, taken) AS (
  SELECT key, n, event_id, ts, ts, true FROM e WHERE n = 1
  UNION ALL SELECT e.key, e.n, e.event_id, e.ts, CASE WHEN epoch(e.ts - r.last)::BIGINT >= {HOUR} THEN e.ts ELSE r.last END, floor(epoch(e.ts - r.last)) >= {HOUR} FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1
)
SELECT key, event_id, ts FROM r WHERE taken""").replace("WITH", "WITH RECURSIVE", 1).replace(")\n\n,", ")\n,"))
def debounce_events(spark: SparkSession, d: str) -> DataFrame:
    return ops.debounced(frames.file_events(spark, d).where("kind IS NOT NULL"), HOUR, rounded=True)


@query(S.with_(S.FILE_EVENTS, f"SELECT event_id, key, ts FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM file_events) WHERE kind IS NOT NULL AND (done IS NULL OR floor(epoch(ts - done)) >= {2 * HOUR})"))
def cooldown_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.file_events(spark, d)
    return ops.cooled(rows.where("kind IS NOT NULL"), rows.where("event_type = 'purchase'"), 2 * HOUR).select("event_id", "key", "ts")


@query("SELECT key, failures, CASE WHEN ok THEN 'uploaded' WHEN failures >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN failures >= 3 THEN 60 ELSE least(60, 2 ** failures) END::BIGINT AS delay FROM (SELECT user_id AS key, count(*) FILTER (event_type = 'error') AS failures, bool_or(event_type = 'purchase') AS ok FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id)")
def retry_state(spark: SparkSession, d: str) -> DataFrame:
    tries = frames.table(spark, d, "events").where("event_type IN ('error', 'purchase')")
    return ops.retry_state(tries.select(F.col("user_id").alias("key"), (F.col("event_type") == "purchase").alias("ok")))


@query("SELECT attempt, CASE WHEN attempt >= 3 THEN 60 ELSE least(60, 2 ** attempt) END::BIGINT AS delay FROM (SELECT DISTINCT event_id % 10 AS attempt FROM events)")
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    attempts = frames.table(spark, d, "events").select((F.col("event_id") % 10).alias("attempt")).distinct()
    return attempts.select("attempt", parse.retry_delay(F.col("attempt")).alias("delay"))


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 10")
def pending_batch(spark: SparkSession, d: str) -> DataFrame:
    queue = frames.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "click", "pending").otherwise("uploaded").alias("status"))
    return ops.pending_batch(queue).select("id", "created_at")


_AGENT = "['Gemini-CLI', 'codex_v2', 'HERMES', 'openclaw', 'Other'][user_id % 5 + 1]"
_AGENT_ID = "['gemini', 'codex', 'hermes', 'openclaw', 'other'][user_id % 5 + 1]"


def _agents(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("element_at(array('Gemini-CLI', 'codex_v2', 'HERMES', 'openclaw', 'Other'), cast(user_id % 5 as int) + 1)")
    return frames.table(spark, d, "events").withColumn("name", name)


@query(f"SELECT {_AGENT_ID} AS agent, max(ts) AS last_seen FROM events GROUP BY 1")
def agent_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.last_seen(_agents(spark, d), parse.agent_id(F.col("name")), F.col("ts"))


@query("SELECT user_id AS agent, max(ts) AS last_seen, floor(epoch(TIMESTAMP '2024-01-29 12:00:00' - max(ts))) > 300 AS offline FROM events GROUP BY user_id")
def device_offline(spark: SparkSession, d: str) -> DataFrame:
    seen = lifecycle.last_seen(frames.table(spark, d, "events"), F.col("user_id"), F.col("ts"))
    return lifecycle.offline(seen, F.expr("timestamp_ntz'2024-01-29 12:00:00'"))


@query(S.with_(S.FILE_EVENTS, "SELECT event_id, (starts_with(path, '/kb/src1') OR starts_with(path, '/kb/src2')) AND NOT contains(path, 'error') AS watched FROM file_events"))
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return frames.file_events(spark, d).select("event_id", ops.watched(F.col("path"), ["*.md", "*.txt"], ["error"], ["/kb/src1", "/kb/src2"]).alias("watched"))


@query(S.with_(S.FILE_EVENTS, "SELECT path, CASE WHEN starts_with(path, '/kb/src1/') THEN 'one' WHEN starts_with(path, '/kb/src1') THEN 'tens' ELSE 'all' END AS config FROM (SELECT DISTINCT path FROM file_events)"))
def owning_config(spark: SparkSession, d: str) -> DataFrame:
    configs = spark.createDataFrame([(1, "/kb/src1/", "one"), (2, "/kb/src1", "tens"), (3, "/kb", "all"), (4, "/kb/src2", "late")], "place int, root string, config string")
    return ops.owners(frames.file_events(spark, d).select("path").distinct(), configs)


@query("SELECT user_id, array_to_string(list_sort(list_filter(after, lambda x: NOT list_contains(before, x))), ',') AS added, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(after, x))), ',') AS removed FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-15'), []) AS before, coalesce(list(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-15'), []) AS after FROM events GROUP BY user_id)")
def watch_diff(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    sets = frames.table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("before"), F.collect_set(F.when(~early, F.col("event_type"))).alias("after"))
    added, removed = ops.watch_changes(F.col("before"), F.col("after"))
    return sets.select("user_id", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"))


@query("SELECT path, agent, event_type, place FROM (SELECT '/out/codex/e' || item_id || '/memory-export.json' AS path, 'codex' AS agent, 'memory_candidate' AS event_type, unnest([0, 1])::BIGINT AS place FROM benchmark WHERE item_id % 2 = 0) UNION ALL SELECT '/out/gemini/n' || item_id || '.md', 'gemini', 'artifact', 0 FROM benchmark WHERE item_id % 2 = 1")
def agent_output_events(spark: SparkSession, d: str) -> DataFrame:
    path = F.expr("case when item_id % 2 = 0 then concat('/out/codex/e', item_id, '/memory-export.json') else concat('/out/gemini/n', item_id, '.md') end")
    content = F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content")), F.struct(F.lit("b").alias("content"))).alias("memories")))).otherwise(F.col("text"))
    return ops.agent_outputs(frames.table(spark, d, "benchmark").select(path.alias("path"), content.alias("content")), "/out")


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'dark' ELSE 'light' END AS theme, 'en' AS lang FROM benchmark")
def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    current = F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("theme"), F.lit("dark"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    backup = F.create_map(F.lit("theme"), F.lit("light"), F.lit("lang"), F.lit("en"))
    rows = frames.table(spark, d, "benchmark").select("item_id", current.alias("current"))
    merged = rows.select("item_id", lifecycle.merge_settings(F.col("current"), backup).alias("m"))
    return merged.select("item_id", F.element_at("m", "theme").alias("theme"), F.element_at("m", "lang").alias("lang"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS slot, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.table(spark, d, "events")
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("slot"), "event_type", "n")
