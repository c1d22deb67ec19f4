"""Memories, devices, tasks, configurations and artifacts: creation, folds over events, lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse

#: Kinds of source that are sessions.
SESSION_SOURCES = ("hermes_session", "codex_session", "gemini_session", "openclaw_session")


def create_memories(requests: DataFrame, now: Column) -> DataFrame:
    """Rows of new memories with their defaults; the source is the explicit one, else the named kind, else manual.

    ``requests``: id, title, content, memory_type, scope, confidence, visibility, tags, source_type, source.
    """
    return requests.select(
        "id", F.lit("memory").alias("type"), "title", "content", F.coalesce("source_type", "source", F.lit("manual")).alias("source_type"), F.lit("active").alias("status"),
        F.to_json(F.coalesce("tags", F.array().cast("array<string>"))).alias("metadata"), now.alias("created_at"), now.alias("updated_at"),
        "memory_type", F.coalesce("scope", F.lit("project")).alias("scope"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"),
        F.coalesce("visibility", F.lit("private")).alias("visibility"), F.lit("unknown").alias("owner"),
    )


def delete(doc: DataFrame, knowledge_ext: DataFrame, condition: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Marks rows as deleted, whatever their status was, with the moment; the versions of deleted knowledge aren't current any more."""
    condition = F.coalesce(condition, F.lit(False))
    gone = doc.where(condition & (F.col("type") == "knowledge")).select("id").distinct().withColumn("gone", F.lit(True))
    after = knowledge_ext.join(gone, "id", "left").withColumn("is_current", F.col("is_current") & F.col("gone").isNull()).drop("gone")
    return doc.withColumns({"status": F.when(condition, "deleted").otherwise(F.col("status")), "updated_at": F.when(condition, now).otherwise(F.col("updated_at"))}), after


def delete_under(doc: DataFrame, knowledge_ext: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Takes the knowledge under the paths of a configuration out of both tables."""
    under = F.greatest(F.lit(False), F.lit(False), *(F.coalesce(F.col("source_path"), F.lit("")).startswith(r) for r in roots)) & (F.col("type") == "knowledge")
    return doc.where(~under), knowledge_ext.join(doc.where(under).select("id").distinct(), "id", "left_anti")


#: What each category of a clearing takes out: rows of doc by type, and whole tables.
CLEARED = {
    "memory": ("memory", ("memory_ext",)), "sessions": ("session", ("session_ext",)), "knowledge": ("knowledge", ("knowledge_ext", "config", "manifest")),
    "artifacts": (None, ("artifact",)), "documents": (None, ("document",)), "configs": (None, ("config",)),
}
UNTAGGED = {"memory_metadata": "memory", "session_metadata": "session", "knowledge_metadata": "knowledge", "embeddings": None}
CONFIRMED = "CONFIRM_CLEAR"


def clear(tables: dict[str, DataFrame], categories: set[str], confirmation: str | None) -> dict[str, DataFrame]:
    """The tables that change when categories are cleared, with what is left of them.

    ``deleted`` takes out what was marked, with its rows in the other tables, and nothing else is cleared with it. Types
    go with their extension tables, metadata categories leave the rows and set their metadata to null, ``all`` empties
    every table. Nothing is cleared without the confirmation.
    """
    if confirmation != CONFIRMED:
        raise ValueError(f"clearing needs the confirmation {CONFIRMED}")
    unknown = categories - {"deleted", "all", *CLEARED, *UNTAGGED}
    if unknown or not categories:
        raise ValueError(f"no such categories: {', '.join(sorted(unknown))}" if unknown else "no category to clear")
    doc = tables["doc"]
    if "deleted" in categories:
        gone = doc.where("status = 'deleted'").select("id").distinct()
        exts = {name: tables[name].join(gone, "id", "left_anti") for name in ("memory_ext", "knowledge_ext", "session_ext") if name in tables}
        return {"doc": doc.where("status IS DISTINCT FROM 'deleted'")} | exts
    if "all" in categories:
        return {name: rows.limit(0) for name, rows in tables.items()}
    out: dict[str, DataFrame] = {}
    untagged = [kind for name, kind in UNTAGGED.items() if name in categories]
    if untagged:
        mine = F.lit(True) if None in untagged else F.col("type").isin(untagged)
        out["doc"] = doc.withColumn("metadata", F.when(~mine, F.col("metadata")))
    for kind, names in (CLEARED[c] for c in sorted(categories & set(CLEARED))):
        if kind:
            out["doc"] = out.get("doc", doc).where(F.col("type").isNull() | (F.col("type") != kind))
        out |= {name: tables[name].limit(0) for name in names if name in tables}
    return out


def devices(events: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """id, status, last_seen of each device after its events (id, at, seq, action: register, approve, heartbeat, revoke).

    The latest event sets the status; an online device that has been silent for longer than the minutes is offline.
    Events before the first registration count for nothing. Each column is a plain aggregate, so that a device with very
    many events is summed up before the shuffle.
    """
    first = F.min(F.when(F.col("action") == "register", F.struct("at", "seq")))
    last = F.max(F.struct("at", "seq", "action"))
    seen = F.max(F.when(F.col("action") == "heartbeat", F.col("at")))
    folded = events.groupBy("id").agg(first.alias("first"), last.alias("last"), seen.alias("seen"))
    after = folded.where("first IS NOT NULL").withColumn("last_seen", F.when(F.col("seen") >= F.col("first.at"), F.col("seen")))
    silent = F.timestamp_diff("SECOND", F.col("last_seen"), now) > 60 * minutes
    status = F.when(F.col("last.action") == "register", "pending").when(F.col("last.action") == "approve", "approved").when(F.col("last.action") == "revoke", "revoked").when(silent, "offline").otherwise("online")
    return after.select("id", status.alias("status"), "last_seen")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of the rows with the number of all of them, which is an aggregate of its own and not a window over everything."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def newest(rows: DataFrame, at: str, limit: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(at), "id").limit(limit)


def most_trusted(memories: DataFrame, limit: int = 10) -> DataFrame:
    return memories.orderBy(F.desc("confidence"), "id").limit(limit)


def shown(memories: DataFrame, source: str = "all", kind: str = "all") -> DataFrame:
    """What a list of memories shows: no sessions, and one source or type if wanted."""
    rows = memories.where(~F.coalesce(F.col("source_type").isin(*SESSION_SOURCES), F.lit(False)))
    rows = rows if source == "all" else rows.where(F.col("source_type") == source)
    return rows if kind == "all" else rows.where(F.col("memory_type") == kind)


def task_counters(tasks: DataFrame) -> DataFrame:
    """Tasks (task_type, queued) in one row of counts."""
    return tasks.agg(
        F.count("*").alias("total"), F.count_if((F.col("task_type") == "indexing") & ~F.col("queued")).alias("indexing"),
        F.count_if("queued").alias("queued"), F.count_if(F.col("task_type").startswith("vectorizing")).alias("vectorizing"),
    )


def recent_tasks(tasks: DataFrame, keep: int = 15) -> DataFrame:
    """The last completed tasks; a top-k, so no window over the whole history."""
    return tasks.where("completed").orderBy(F.desc("ended_at"), F.desc("id")).limit(keep)


def folder_sizes(files: DataFrame, depth: int) -> DataFrame:
    """files and bytes under each folder of so many steps; ``files``: path, length."""
    folder = F.substring_index("path", "/", depth + 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def index_state(files: DataFrame) -> DataFrame:
    """path, hash and length of each file as indexed, to be compared with at the next scan; of repeated paths the largest hash."""
    return files.groupBy("path").agg(F.max(F.struct(parse.content_hash(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("bytes"))).alias("top")).select("path", "top.hash", "top.bytes")


def next_run(at: Column, now: Column) -> Column:
    """The next moment after now at a time of day HH:MM."""
    minutes = F.split(at, ":")[0].cast("int") * 60 + F.split(at, ":")[1].cast("int")
    today = F.timestamp_add("MINUTE", minutes, F.date_trunc("day", now).cast("timestamp_ntz"))
    return F.when(today > now, today).otherwise(F.timestamp_add("DAY", F.lit(1), today))


def due(at: Column, now: Column, last_run: Column) -> Column:
    """Whether a task for a time of day HH:MM is to run in this minute: it is its time, and it hasn't run today."""
    return (F.date_format(now, "HH:mm") == at) & ~F.coalesce(last_run.cast("date") == now.cast("date"), F.lit(False))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by order; one aggregation, so that a key with very many rows is summed up first."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*(F.col(c) if c in keys else F.col(f"first.{c}") for c in rows.columns))


def installed_agents(probes: DataFrame) -> DataFrame:
    """The agents found on machines: of valid probes (agent_type, environment, path, valid) one per type and environment, by the smallest path."""
    return first_by(probes.where("valid").drop("valid"), ["agent_type", "environment"], ["path"])


def all_paths(configs: DataFrame) -> DataFrame:
    """The paths of all configurations as rows, in the configurations' order: place, path."""
    return configs.select("id", F.posexplode("paths").alias("place", "path"))


def _versioned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, and new ones beside them: an id that is there becomes ``id-vN``, one more than the highest version of it that there is."""
    base, number = F.regexp_replace("id", r"-v[0-9]+$", ""), F.coalesce(F.try_to_number(F.regexp_extract("id", r"-v([0-9]{1,9})$", 1), F.lit("999999999")).cast("long"), F.lit(1))
    highest = old.groupBy(base.alias("base")).agg(F.max(number).alias("highest"))
    known = old.select("id").distinct().withColumn("known", F.lit(True))
    rows = new.withColumn("base", base).join(highest, "base", "left").join(known, "id", "left")
    again = rows.withColumn("nth", F.row_number().over(Window.partitionBy("base", "known").orderBy("id")))
    name = F.when(F.col("known"), F.concat("base", F.lit("-v"), (F.col("highest") + F.col("nth")).cast("string"))).otherwise(F.col("id"))
    return old.unionByName(again.select(name.alias("id"), "title", "content"))


def import_rows(old: DataFrame, rows: DataFrame, strategy: str, order: str = "place") -> DataFrame:
    """id, title, content after an import: skip keeps old rows, overwrite replaces them, merge appends contents, version adds rows with a new id."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("nth = 1").select("id", "title", "content")
    old = old.select("id", "title", "content")
    if strategy == "version":
        return _versioned(old, first)
    new = first.select("id", F.col("title").alias("new_title"), F.col("content").alias("new_content"), F.lit(True).alias("there"))
    both = old.withColumn("known", F.lit(True)).join(new, "id", "full_outer")
    old_first = {"skip": True, "overwrite": False, "merge": True}[strategy]
    pick = lambda c: F.when(F.col("known" if old_first else "there"), F.col(c if old_first else f"new_{c}")).otherwise(F.col(f"new_{c}" if old_first else c))
    content = F.concat_ws("\n\n", "content", "new_content") if strategy == "merge" else pick("content")
    return both.select("id", pick("title").alias("title"), content.alias("content"))


def health_score(doc: DataFrame) -> DataFrame:
    """0 to 100: the mean share of active rows, of rows with content and of rows with tags; 0 without rows."""
    share = lambda c: F.coalesce(F.count_if(c) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    tagged = ~F.coalesce(F.col("metadata"), F.lit("")).isin("", "{}", "[]")
    parts = share(F.col("status") == "active") + share(F.coalesce(F.length("content"), F.lit(0)) > 0) + share(tagged)
    return doc.agg(F.round(100 * parts / 3, 4).alias("score"), F.count("*").alias("n"))
