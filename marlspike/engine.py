"""The corpus behind one object: tables in a folder, changed by commits, and the operations on them.

A table's rows lie in buckets by a hash of their key. A change rewrites the buckets that it touches and no others, of
all its tables, and counts from the moment that its commit is there: a small file that names the folder of each bucket.
The commit's number is taken once; a writer that comes second starts again from what the first has left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parse
from .operators import administration, entities, exchange, ingest, lifecycle, retrieval, search, stats, versioning
from .sources.folders import exists, path_of

TABLES = {
    "doc": "id string, type string, title string, content string, status string, source_type string, source_path string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "memory_ext": "id string, memory_type string, scope string, visibility string, confidence double",
    "knowledge_ext": "id string, version bigint, is_current boolean",
    "session_ext": "id string, agent string, message_count bigint",
    "candidate": "id string, title string, content string, proposed_type string, proposed_scope string, confidence double, source_agent_id string, review_status string, created_at timestamp_ntz",
    "embedding": "id string, embedding array<float>",
    "device_event": "id string, at timestamp_ntz, seq bigint, action string",
    "source_file": "id string, event_id string, workspace_id string, device_id string, data_source_id string, path string, normalized_path string, file_name string, extension string, size_bytes bigint, mtime string, sha256 string, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "artifact": "id string, workspace_id string, title string, artifact_type string, content string, mime_type string, source_device_id string, source_agent_id string, sha256 string, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "rejected": "request_id string, place int, part string, violations array<string>",
    "config": "id string, name string, paths array<string>, file_patterns array<string>, auto_index boolean, at timestamp_ntz, seq bigint, op string, given array<string>",
    "data_source": "id string, name string, path string, source_type string, status string, at timestamp_ntz, seq bigint, op string, given array<string>",
    "workspace": "id string, name string, description string, settings string, at timestamp_ntz, seq bigint, op string, given array<string>",
    "manifest": "path string, mtime timestamp, length bigint, hash string",
}
#: Tables whose rows are found by another column than the id.
KEYS = {"manifest": "path", "rejected": "request_id"}
#: Tables that hold changes of entities, and the entities' fields.
ENTITIES = {"config": ["name", "paths", "file_patterns", "auto_index"], "data_source": ["name", "path", "source_type", "status"], "workspace": ["name", "description", "settings"]}
#: Requests a minute that a service reports as its limits.
POLICY = {"search_per_minute": 60, "submit_per_minute": 10, "context_per_minute": 30}
BUCKETS = 64
TRIES = 5


def now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


class ConcurrentChange(RuntimeError):
    """Others have committed first, again and again."""


@dataclass
class State:
    """The tables as of a commit."""

    engine: Engine
    number: int = 0
    folders: dict[str, dict[str, str]] = field(default_factory=dict)

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or only some buckets of it."""
        spark = self.engine.spark
        paths = [f"{self.engine.root}/{p}" for b, p in self.folders.get(name, {}).items() if buckets is None or int(b) in buckets]
        return spark.read.schema(TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[name])

    def touched(self, name: str, rows: DataFrame) -> set[int]:
        """The buckets of a table that rows with its key fall into: as many numbers as there are buckets, at most."""
        return {r.bucket for r in rows.select(self.engine.bucket(name).alias("bucket")).distinct().collect()}


class Engine:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ------------------------------------------------------------ tables and commits

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(KEYS.get(name, "id")), F.lit(self.buckets)).cast("int")

    def state(self) -> State:
        """The tables as of the last commit."""
        folder, fs = path_of(self.spark, f"{self.root}/_commits")
        made = sorted(str(s.getPath()) for s in fs.listStatus(folder)) if fs.exists(folder) else []
        for path in reversed(made):
            text = self.spark.read.option("wholetext", True).text(path).first()
            try:
                found = json.loads(text.value if text else "")
            except ValueError:
                continue  # being written
            return State(self, found["number"], found["tables"])
        return State(self)

    def table(self, name: str) -> DataFrame:
        return self.state().table(name)

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """The folders of the buckets that rows make up."""
        columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], TABLES[name]).schema]
        part = f"{name}/{uuid.uuid4().hex}"
        rows.select(*columns).withColumn("bucket", self.bucket(name)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{part}")
        folder, fs = path_of(self.spark, f"{self.root}/{part}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return {n.removeprefix("bucket="): f"{part}/{n}" for n in names if n.startswith("bucket=")}

    def commit(self, state: State, changes: dict[str, tuple[DataFrame, set[int] | None]]) -> None:
        """Replace buckets of tables (None: all of them) by rows, in one commit after ``state``; fails if there is another one."""
        folders = {name: dict(parts) for name, parts in state.folders.items()}
        for name, (rows, buckets) in changes.items():
            kept = {} if buckets is None else {b: p for b, p in folders.get(name, {}).items() if int(b) not in buckets}
            folders[name] = kept | self._write(name, rows)
        path, fs = path_of(self.spark, f"{self.root}/_commits/{state.number + 1:012d}.json")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps({"number": state.number + 1, "tables": folders}).encode()))
        out.close()

    def change(self, build: Callable[[State], dict[str, tuple[DataFrame, set[int] | None]]]) -> bool:
        """Commit what ``build`` makes of the present state; again from the new state if others were first. Without changes nothing is written."""
        for _ in range(TRIES):
            state = self.state()
            changes = build(state)
            if not changes:
                return False
            try:
                self.commit(state, changes)
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
        raise ConcurrentChange(f"{TRIES} others were first")

    def put(self, name: str, rows: DataFrame) -> None:
        """Replace a whole table."""
        self.change(lambda _: {name: (rows, None)})

    def _add(self, name: str, new: Callable[[State], DataFrame]) -> None:
        """Add rows whose ids aren't there yet."""

        def build(state: State):
            rows = new(state)
            buckets = state.touched(name, rows)
            old = state.table(name, buckets)
            return {name: (old.unionByName(lifecycle.insert_or_ignore(old, rows, "id"), allowMissingColumns=True), buckets)} if buckets else {}

        self.change(build)

    # ------------------------------------------------------------ reading

    def search(self, query: str, source_types: str | None = None, limit: int = 50, **filters) -> DataFrame:
        """Filters as in operators.search.filters: least_confidence, since, until, tags, types."""
        state = self.state()
        return search.search(state.table("doc"), state.table("memory_ext"), query, source_types, limit, where=search.filters(**filters))

    def list(self, source_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        state = self.state()
        return search.listed(state.table("doc"), state.table("memory_ext"), source_type, limit, offset)

    def context(self, task: str, limit: int = 10, **filters) -> DataFrame:
        state = self.state()
        return search.context_pack(state.table("doc"), state.table("memory_ext"), task, limit, where=search.filters(**filters))

    def hybrid(self, query: str, wanted: list[float] | None = None, budget: int = 2000, limit: int = 10) -> DataFrame:
        """Diverse hits of keywords and vectors that fit into a budget of tokens together."""
        state = self.state()
        return retrieval.hybrid(state.table("doc"), state.table("embedding"), query, wanted, budget, limit)

    def stats(self) -> DataFrame:
        return stats.data_stats(self.table("doc"))

    def policy(self) -> dict[str, int]:
        return dict(POLICY)

    def devices(self, at: Column | None = None) -> DataFrame:
        return administration.devices(self.table("device_event"), now() if at is None else at)

    def entities(self, kind: str) -> DataFrame:
        """Configurations, data sources or workspaces that live."""
        return entities.living(entities.fold(self.table(kind), ENTITIES[kind]))

    # ------------------------------------------------------------ memories

    def create(self, requests: DataFrame) -> None:
        """New memories: id, title, content, memory_type, scope, confidence, visibility, tags, source_type, source."""

        def build(state: State):
            rows = administration.create_memories(requests, now())
            buckets = state.touched("doc", rows)
            old, ext = state.table("doc", buckets), state.table("memory_ext", buckets)
            fresh = lifecycle.insert_or_ignore(old, rows, "title").withColumn("source_path", F.lit(""))
            docs = old.unionByName(fresh.select(*(c for c in old.columns if c in fresh.columns)), allowMissingColumns=True)
            exts = ext.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*ext.columns))
            return {"doc": (docs, buckets), "memory_ext": (exts, buckets)} if buckets else {}

        self.change(build)

    def patch(self, changes: DataFrame, fields: list[str]) -> None:
        """Changes (id, at, seq, op, given, fields) of documents, several to an id and in any order."""

        def build(state: State):
            buckets = state.touched("doc", changes)
            return {"doc": (entities.patched(state.table("doc", buckets), changes, fields), buckets)} if buckets else {}

        self.change(build)

    def delete(self, **criteria) -> None:
        """Criteria as in operators.lifecycle.deletion: ids, source_type or all_of."""
        condition = lifecycle.deletion(**criteria)

        def build(state: State):
            buckets = state.touched("doc", state.table("doc").where(condition))
            doc, ext = administration.delete(state.table("doc", buckets), state.table("knowledge_ext", buckets), condition, now())
            return {"doc": (doc, buckets), "knowledge_ext": (ext, buckets)} if buckets else {}

        self.change(build)

    def restore(self) -> None:
        def build(state: State):
            buckets = state.touched("doc", state.table("doc").where("status = 'deleted'"))
            return {"doc": (lifecycle.restore_deleted(state.table("doc", buckets)), buckets)} if buckets else {}

        self.change(build)

    def clear(self, categories: set[str], confirmation: str | None = None) -> None:
        """Categories as in operators.administration.clear; needs its confirmation."""
        self.change(lambda state: {n: (rows, None) for n, rows in administration.clear({t: state.table(t) for t in TABLES}, categories, confirmation).items()})

    def import_(self, rows: DataFrame, strategy: str) -> None:
        """Rows (id, title, content, place) into the documents, by skip, overwrite, merge or version."""

        def build(state: State):
            old = state.table("doc")
            after = administration.import_rows(old, rows, strategy).withColumnsRenamed({"title": "new_title", "content": "new_content"})
            both = old.join(after, "id", "full_outer")
            moved = F.col("status").isNull() | ~(F.col("content").eqNullSafe(F.col("new_content")) & F.col("title").eqNullSafe(F.col("new_title")))
            values = {"title": F.col("new_title"), "content": F.col("new_content"), "type": F.coalesce("type", F.lit("memory")), "status": F.coalesce("status", F.lit("active")), "source_type": F.coalesce("source_type", F.lit("manual")), "created_at": F.when(F.col("status").isNull(), now()).otherwise(F.col("created_at")), "updated_at": F.when(moved, now()).otherwise(F.col("updated_at"))}
            changed = both.where(moved)
            buckets = state.touched("doc", changed)
            return {"doc": (both.where(self.bucket("doc").isin(list(buckets))).select(*((values[c].alias(c) if c in values else F.col(c)) for c in old.columns)), buckets)} if buckets else {}

        self.change(build)

    def export(self, path: str, export_id: str, exported_at: str, **selection) -> dict:
        """Writes the selected memories (status, ids, kind); returns the outer document, with their number."""
        state = self.state()
        rows = search.with_memory_defaults(state.table("doc"), state.table("memory_ext"), "shared")
        return exchange.write_export(exchange.export_items(exchange.export_selection(rows, **selection)), path, export_id, exported_at)

    # ------------------------------------------------------------ review

    def submit(self, rows: DataFrame) -> None:
        """Adds candidates (id, title, content, type, scope, confidence, agent_id) whose ids are new."""
        self._add("candidate", lambda _: exchange.candidates(rows).withColumn("created_at", now()))

    def review(self, approve: list[str] = (), reject: list[str] = ()) -> None:
        """Approved candidates become memories, in the same commit."""
        none = F.lit(False)
        chosen, turned_down = (F.col("id").isin(list(ids)) if ids else none for ids in (approve, reject))

        def build(state: State):
            waiting = state.table("candidate").where((F.col("review_status") == "needs_review") & (chosen | turned_down))
            buckets = state.touched("candidate", waiting)
            if not buckets:
                return {}
            candidates, doc, ext = (state.table(t, buckets) for t in ("candidate", "doc", "memory_ext"))
            new = lifecycle.approve(candidates, chosen).withColumns({"source_path": F.lit(""), "metadata": F.lit("[]"), "created_at": now(), "updated_at": now()})
            return {
                "memory_ext": (lifecycle.upsert(ext, new.select(*ext.columns)), buckets),
                "doc": (doc.unionByName(lifecycle.insert_or_ignore(doc, new.select(*doc.columns), "title")), buckets),
                "candidate": (lifecycle.review(candidates, chosen, turned_down), buckets),
            }

        self.change(build)

    # ------------------------------------------------------------ what is handed in

    def _ingest(self, name: str, parts: DataFrame, rows: DataFrame) -> DataFrame:
        """Adds valid rows and keeps the others with their reasons; returns what the requests are answered."""

        def build(state: State):
            buckets, wrong = state.touched(name, rows), ingest.rejected(parts)
            lost = state.touched("rejected", wrong)
            old, kept = state.table(name, buckets), state.table("rejected", lost)
            out = {name: (old.unionByName(lifecycle.insert_or_ignore(old, rows, "id"), allowMissingColumns=True), buckets)} if buckets else {}
            return out | ({"rejected": (kept.unionByName(wrong.join(kept.select("request_id", "place"), ["request_id", "place"], "left_anti")), lost)} if lost else {})

        self.change(build)
        return ingest.outcome(parts)

    def ingest_file_events(self, requests: DataFrame) -> DataFrame:
        parts = ingest.file_event_parts(requests)
        return self._ingest("source_file", parts, ingest.source_files(parts, now()))

    def ingest_artifacts(self, requests: DataFrame) -> DataFrame:
        parts = ingest.artifact_parts(requests)
        return self._ingest("artifact", parts, ingest.artifacts(parts, now()))

    def ingest_memories(self, requests: DataFrame) -> DataFrame:
        parts = ingest.memory_parts(requests)
        return self._ingest("candidate", parts, ingest.candidates(parts, now()))

    def record(self, name: str, events: DataFrame) -> None:
        """Appends events of devices, or changes of configurations, data sources or workspaces."""

        def build(state: State):
            buckets = state.touched(name, events)
            return {name: (state.table(name, buckets).unionByName(events, allowMissingColumns=True), buckets)} if buckets else {}

        self.change(build)

    # ------------------------------------------------------------ files

    def changes(self, scanned: DataFrame) -> DataFrame:
        state = self.state()
        return versioning.classify(versioning.current(state.table("doc"), state.table("knowledge_ext")), scanned)

    def reindex(self, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> bool:
        """Takes a folder's listing (path, mtime, length) in; says whether anything had to be written.

        Only files whose state differs from the stored one are read: ``read`` turns their paths into path, content. Old
        versions are archived, with their dates, and files that are gone are deleted; only buckets with such rows change.
        """

        def build(state: State):
            manifest = state.table("manifest")
            fresh, gone = versioning.to_read(listing, manifest), versioning.vanished(listing, manifest)
            if fresh.isEmpty() and gone.isEmpty():
                return {}
            scanned = read(fresh.select("path")).select("path", "content")
            paths = scanned.select("path").unionByName(gone).distinct()
            doc, ext = state.table("doc"), state.table("knowledge_ext")
            existing = versioning.current(doc, ext).join(paths.withColumnRenamed("path", "source_path"), "source_path", "left_semi").select("id", "source_path", "content", "title", "metadata", "created_at")
            after = versioning.reindex(existing, ext, scanned, now())
            buckets = state.touched("doc", after)
            old = state.table("doc", buckets)
            texts = scanned.select("path", F.col("content").alias("fresh"))
            both = old.join(after.withColumnsRenamed({"status": "new_status", "created_at": "born", "updated_at": "moved"}), "id", "full_outer").join(texts, "path", "left")
            new = F.col("type").isNull()
            values = {
                "type": F.coalesce("type", F.lit("knowledge")), "title": F.when(new, parse.file_name(F.col("path"))).otherwise(F.col("title")), "content": F.when(new, F.col("fresh")).otherwise(F.col("content")),
                "status": F.coalesce("new_status", "status"), "source_type": F.coalesce("source_type", F.lit("knowledge")), "source_path": F.coalesce("source_path", "path"), "metadata": F.when(new, "[]").otherwise(F.col("metadata")),
                "created_at": F.coalesce("created_at", "born"), "updated_at": F.coalesce("moved", "updated_at"),
            }
            docs = both.select("id", *(values[c].alias(c) for c in old.columns if c != "id"))
            versions = state.table("knowledge_ext", buckets).join(after.select("id"), "id", "left_anti").unionByName(after.select("id", "version", "is_current"))
            seen = listing.join(fresh.select("path"), "path", "left_semi").join(scanned.select("path", F.sha2("content", 256).alias("hash")), "path").select("path", "mtime", "length", "hash")
            places = state.touched("manifest", paths)
            entries = state.table("manifest", places).join(paths, "path", "left_anti").unionByName(seen)
            out = {"manifest": (entries, places)}
            return out | ({"doc": (docs, buckets), "knowledge_ext": (versions, buckets)} if buckets else {})

        return self.change(build)
