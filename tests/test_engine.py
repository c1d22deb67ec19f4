"""The engine's life cycle, back-ends and agents' files."""

import datetime
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from marlspike.engine import Engine
from marlspike.operators import backends, exchange
from marlspike.sources import agents, cache, frames

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}", buckets=4)
    out.put("doc", frames.doc(spark, DATA))
    out.put("memory_ext", frames.memory_ext(spark, DATA))
    out.put("knowledge_ext", frames.knowledge_ext(spark, DATA))
    return out


def test_search_and_context(engine):
    assert 0 < engine.search("the").count() <= 50
    assert engine.search("no such words anywhere").count() == 0
    assert engine.search("100%_").count() == 0  # signs mean themselves
    paths = [r.id for r in engine.context("e", 5).collect()]
    assert len(paths) == len(set(paths)) == 5


def test_submit_review_delete_restore(spark, engine):
    rows = spark.createDataFrame([("n1", "", "some text", None, None, None, "codex"), ("n2", "t", "x", "decision", "global", 0.2, None)], "id string, title string, content string, type string, scope string, confidence double, agent_id string")
    engine.submit(rows)
    engine.submit(rows)
    assert engine.table("candidate").count() == 2
    engine.review(approve=["n1"], reject=["n2"])
    engine.review(approve=["n2"])  # decided already
    assert {r.id: r.review_status for r in engine.table("candidate").collect()} == {"n1": "approved", "n2": "rejected"}
    got = engine.table("doc").where("id IN ('n1', 'n2')").collect()
    assert [(r.id, r.source_type, r.title) for r in got] == [("n1", "codex", "some text")]
    engine.delete(ids=["n1"])
    assert engine.table("doc").where("id = 'n1'").first().status == "deleted"
    engine.restore()
    assert engine.table("doc").where("status = 'deleted'").count() == 0


def rows_of(engine, ids, *columns):
    found = engine.table("doc").where(F.col("id").isin(ids)).collect()
    return {r.id: tuple(r[c] for c in columns) for r in found}


MEMORY = "id string, title string, content string, memory_type string, scope string, confidence double, visibility string, tags array<string>, source_type string, source string"
CHANGE = "id string, at timestamp_ntz, seq long, op string, given array<string>, title string, content string"


def test_create_read_patch_delete(spark, engine):
    """The life of a memory."""
    engine.create(spark.createDataFrame([("c1", "first", "some words", "decision", None, None, None, ["t"], None, None), ("c2", "second", "others", "semantic", "global", 0.4, None, None, "codex", None)], MEMORY))
    engine.create(spark.createDataFrame([("c1", "again", "x", "decision", None, None, None, None, None, None)], MEMORY))
    assert rows_of(engine, ["c1", "c2"], "title", "status", "source_type", "metadata") == {"c1": ("first", "active", "manual", '["t"]'), "c2": ("second", "active", "codex", "[]")}
    assert engine.table("memory_ext").where("id IN ('c1', 'c2')").count() == 2
    at = datetime.datetime(2030, 1, 1)
    changes = [("c1", at, 3, "set", ["title"], "later", None), ("c1", at, 1, "set", ["title", "content"], "sooner", "new"), ("nobody", at, 1, "set", ["title"], "x", None), ("c2", at, 2, "set", ["content"], None, None)]
    engine.patch(spark.createDataFrame(changes, CHANGE), ["title", "content"])
    assert rows_of(engine, ["c1", "c2", "nobody"], "title", "content", "updated_at") == {"c1": ("later", "new", at), "c2": ("second", None, at)}
    engine.delete(source_type="codex")
    after = rows_of(engine, ["c1", "c2"], "status", "updated_at")
    assert after["c1"] == ("active", at) and after["c2"][0] == "deleted" and after["c2"][1] != at
    assert engine.table("doc").where("type = 'session' AND source_type LIKE 'codex%' AND status = 'deleted'").count() == frames.sessions(spark, DATA).where("source_type LIKE 'codex%' AND status = 'deleted'").count()
    engine.restore()
    with pytest.raises(ValueError):
        engine.delete()


def test_filters_of_a_search(engine):
    everything = engine.search("e", limit=1000).count()
    known = engine.search("e", limit=1000, types=["knowledge"])
    assert 0 < known.count() < everything and {r.type for r in known.collect()} == {"knowledge"}
    assert engine.search("e", limit=1000, least_confidence=0.9).where("confidence < 0.9").count() == 0
    assert engine.search("e", limit=1000, tags=["note"]).count() <= everything
    assert engine.context("e", 5, types=["memory"]).where("type <> 'memory'").count() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", buckets=16)
    engine.put("doc", frames.doc(spark, DATA))
    before = engine.state()
    some = engine.table("doc").where("type = 'memory'").first().id
    engine.delete(ids=[some])
    after = engine.state()
    moved = [b for b, p in after.folders["doc"].items() if before.folders["doc"][b] != p]
    assert len(moved) == 1 and after.number == before.number + 1
    assert engine.table("doc").count() == frames.doc(spark, DATA).count()
    engine.delete(ids=["nobody"])
    assert engine.state().number == after.number


def test_a_writer_that_comes_second_starts_again(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", buckets=2)
    event = lambda i: spark.createDataFrame([(i, datetime.datetime(2024, 1, 1), 1, "register")], "id string, at timestamp_ntz, seq long, action string")
    engine.record("device_event", event("a"))
    calls = []

    def build(state):
        if not calls:
            engine.record("device_event", event("b"))  # another writer, in between
        calls.append(state.number)
        return {"device_event": (state.table("device_event").unionByName(event("c")), None)}

    assert engine.change(build) and calls == [1, 2]
    assert {r.id for r in engine.table("device_event").collect()} == {"a", "b", "c"}
    assert {r.status for r in engine.devices(F.expr("timestamp_ntz'2024-01-01 00:01:00'")).collect()} == {"pending"}


def test_clear(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", buckets=2)
    engine.put("doc", frames.doc(spark, DATA))
    engine.put("memory_ext", frames.memory_ext(spark, DATA))
    with pytest.raises(ValueError):
        engine.clear({"memory"})
    with pytest.raises(ValueError):
        engine.clear({"nothing like it"}, "CONFIRM_CLEAR")
    engine.clear({"memory", "session_metadata"}, "CONFIRM_CLEAR")
    assert engine.table("memory_ext").count() == engine.table("doc").where("type = 'memory'").count() == 0
    assert engine.table("doc").where("type = 'session' AND metadata IS NOT NULL").count() == 0 < engine.table("doc").where("type = 'session'").count()
    engine.clear({"all"}, "CONFIRM_CLEAR")
    assert engine.table("doc").count() == 0


def test_ingest_keeps_what_is_wrong(spark, engine):
    good = {"event_id": "e1", "data_source_id": "s", "event_type": "file_created", "path": "/A/B.md", "size_bytes": 3}
    requests = spark.createDataFrame([("r1", json.dumps({"device_id": "d", "events": [good, {"event_id": "e2"}]})), ("r2", "no json")], "request_id string, json string")
    answer = engine.ingest_file_events(requests)
    assert sorted((r.request_id, r.place, r.accepted) for r in answer.collect()) == [("r1", 0, True), ("r1", 1, False), ("r2", 0, False)]
    engine.ingest_file_events(requests)
    assert [(r.event_id, r.normalized_path, r.extension, r.size_bytes) for r in engine.table("source_file").collect()] == [("e1", "/a/b.md", "md", 3)]
    assert sorted((r.request_id, r.place, len(r.violations)) for r in engine.table("rejected").collect()) == [("r1", 1, 3), ("r2", 0, 1)]
    engine.ingest_artifacts(spark.createDataFrame([("a1", json.dumps({"agent_id": "g", "artifacts": [{"title": "t", "content": "c"}, {"title": 1}]})), ("a2", json.dumps({"artifact_type": "x"}))], "request_id string, json string"))
    assert sorted((r.title, r.artifact_type, r.source_agent_id) for r in engine.table("artifact").collect()) == [("Untitled", "x", "unknown"), ("t", "document", "g")]
    engine.ingest_memories(spark.createDataFrame([("m1", json.dumps({"memories": [{"content": "kept"}, {"confidence": 2}]}))], "request_id string, json string"))
    assert [(r.title, r.confidence) for r in engine.table("candidate").where("content = 'kept'").collect()] == [("Untitled Memory", 0.5)]


def test_entities_of_the_engine(spark, engine):
    at = datetime.datetime(2024, 1, 1)
    kind = "id string, at timestamp_ntz, seq long, op string, given array<string>, name string, description string, settings string"
    engine.record("workspace", spark.createDataFrame([("w1", at, 2, "set", ["description"], None, "d", None), ("w2", at, 3, "delete", [], None, None, None)], kind))
    engine.record("workspace", spark.createDataFrame([("w1", at, 1, "set", ["name", "description"], "n", "old", None), ("w2", at, 1, "set", ["name"], "x", None, None)], kind))
    assert [(r.id, r.name, r.description, r.settings) for r in engine.entities("workspace").collect()] == [("w1", "n", "d", None)]


def test_imports_of_the_engine(spark, engine):
    old = engine.table("doc").where("type = 'memory' AND status = 'active'").orderBy("id").limit(2).collect()
    rows = spark.createDataFrame([(old[0].id, "t", "c", 1), ("brand new", "n", "m", 2)], "id string, title string, content string, place int")
    count = engine.table("doc").count()
    engine.import_(rows, "skip")
    assert engine.table("doc").count() == count + 1 and rows_of(engine, [old[0].id], "title") == {old[0].id: (old[0].title,)}
    engine.import_(rows, "version")
    engine.import_(rows, "version")
    assert set(rows_of(engine, [f"{old[0].id}-v2", f"{old[0].id}-v3", "brand new-v3"], "title").values()) == {("t",), ("n",)}
    engine.import_(rows, "overwrite")
    assert rows_of(engine, [old[0].id, old[1].id], "title", "content") == {old[0].id: ("t", "c"), old[1].id: (old[1].title, old[1].content)}


def test_export_and_read_again(spark, engine, tmp_path):
    outer = engine.export(f"file://{tmp_path}/e", "x1", "2024-01-01T00:00:00", kind="memory")
    rows = engine.table("doc").where("type = 'memory' AND status = 'active'")
    assert (outer["schema_version"], outer["total_count"]) == ("2.0", rows.count())
    again = exchange.read_export(spark, f"file://{tmp_path}/e")
    assert {(r.id, r.content) for r in again.collect()} == {(r.id, r.content or "") for r in rows.collect()}
    some = [r.id for r in rows.limit(3).collect()]
    assert engine.export(f"file://{tmp_path}/f", "x2", "2024-01-01T00:00:00", ids=some)["total_count"] == 3
    spark.createDataFrame([("{}",)], "value string").write.mode("append").text(f"file://{tmp_path}/f/memories")
    with pytest.raises(ValueError):
        exchange.read_export(spark, f"file://{tmp_path}/f")


def test_reindex_reads_and_writes_only_what_changed(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e", buckets=8)
    folder = {"/kb/a.md": "one", "/kb/b.md": "two", "/kb/c.md": "three"}
    times = dict.fromkeys(folder, 1)
    asked = []

    def listing():
        return spark.createDataFrame([(p, datetime.datetime.fromtimestamp(times[p]), len(t)) for p, t in folder.items()], "path string, mtime timestamp, length long")

    def read(paths):
        got = [r.path for r in paths.collect()]
        asked.append(sorted(got))
        return spark.createDataFrame([(p, folder[p]) for p in got], "path string, content string")

    def now_there():
        rows = engine.table("doc").join(engine.table("knowledge_ext"), "id").collect()
        return sorted((r.source_path, r.version, r.status, r.is_current, r.content) for r in rows)

    assert engine.reindex(listing(), read)
    first = engine.state()
    assert now_there() == [("/kb/a.md", 1, "active", True, "one"), ("/kb/b.md", 1, "active", True, "two"), ("/kb/c.md", 1, "active", True, "three")]
    born = rows_of(engine, [r.id for r in engine.table("doc").collect()], "source_path", "created_at")
    assert not engine.reindex(listing(), read) and engine.state().number == first.number and len(asked) == 1
    folder["/kb/a.md"], times["/kb/a.md"] = "one again", 2
    times["/kb/b.md"] = 2
    del folder["/kb/c.md"]
    assert engine.reindex(listing(), read)
    assert asked[-1] == ["/kb/a.md", "/kb/b.md"]
    assert now_there() == [("/kb/a.md", 1, "archived", False, "one"), ("/kb/a.md", 2, "active", True, "one again"), ("/kb/b.md", 1, "active", True, "two"), ("/kb/c.md", 1, "deleted", False, "three")]
    by_path = dict(born.values())
    for r in engine.table("doc").collect():
        assert r.created_at == by_path[r.source_path] and r.updated_at > by_path[r.source_path]
    folder["/kb/c.md"], times["/kb/c.md"] = "back", 5
    assert engine.reindex(listing(), read) and asked[-1] == ["/kb/c.md"]


def test_conversions_are_kept_by_content(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def upper(data):
        counted.add(1)
        if data == b"bad":
            raise ValueError("broken")
        return data.decode().upper()

    source = tmp_path / "in"
    source.mkdir()
    for name, text in (("a.up", "x"), ("b.up", "x"), ("c.up", "bad"), ("d.up", "y")):
        (source / name).write_text(text)

    def go():
        files = spark.read.format("binaryFile").load(f"file://{source}")
        found = cache.converted(files, f"file://{tmp_path}/cache", {"up": upper}).collect()
        return {r.path.rsplit("/", 1)[1]: (r.text or "").strip() or r.error for r in found}

    first = go()
    assert first == {"a.up": "X", "b.up": "X", "c.up": "ValueError: broken", "d.up": "Y"} and counted.value == 3
    assert go() == first and counted.value == 3
    (source / "e.up").write_text("y")
    (source / "a.up").write_text("zz")
    assert go() == first | {"a.up": "ZZ", "e.up": "Y"} and counted.value == 4


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "yy")], "id string, text string")
    cache = spark.createDataFrame([("x", [9.0])], "t string, embedding array<float>").select(F.sha2("t", 256).alias("text_hash"), "embedding")
    got = {r.id: r.embedding for r in backends.embed(texts, lambda ts: [[float(len(t))] for t in ts], cache).collect()}
    assert got == {"a": [9.0], "b": [9.0], "c": [2.0]}


def test_light_embed_fills_only_what_is_missing(spark):
    doc = frames.doc(spark, DATA)
    got = backends.light_embed(doc)
    assert got.join(doc.where("metadata = '[\"note\"]'"), "id").count() == 0 and got.count() > 0


def test_back_ends_by_kind_and_summaries(spark):
    doc = frames.doc(spark, DATA)
    ids = lambda kind: {r.id for r in backends.light_embed(doc, lambda t, c: "word", kind).collect()}
    assert ids("memory") | ids("session") | ids("knowledge") == ids(None) and ids("codex") < ids("memory")
    rows = spark.createDataFrame([("a", "é" * 10), ("b", ""), ("c", None), ("d", "drop")], "id string, content string")
    got = {r.id: r.summary for r in backends.summarize(rows, lambda t, most: "" if t == "drop" else f" {len(t)} {t}", 6, most_bytes=5).collect()}
    assert got == {"a": "2 éé"}


def test_agents_files(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "m.db")
    con.execute("CREATE TABLE chunks (id INTEGER, source TEXT, text TEXT)")
    con.executemany("INSERT INTO chunks VALUES (?, ?, ?)", [(1, "memory", "keep"), (2, "other", "no"), (3, "memory", " ")])
    con.commit()
    data = (tmp_path / "m.db").read_bytes()
    files = spark.createDataFrame([("/m.db", bytearray(data)), ("/bad.db", bytearray(b"no database"))], "path string, content binary")
    assert [(r.title, r.content) for r in agents.sqlite_files(files).collect()] == [("1", "keep")]
    texts = spark.createDataFrame([("/a.json", '{"title":"t","summary":"s"}'), ("/b.json", '{"title":"t"}'), ("/c.md", "é" * 3000), ("/d.md", "  ")], "path string, value string")
    assert [(r.title, r.content) for r in agents.summary_files(texts).collect()] == [("t", "s")]
    assert [r.title for r in agents.markdown_files(texts).collect()] == ["c", "d"]
    known = spark.createDataFrame([("/a.json",)], "source_path string")
    assert {r.path: len(r.content) for r in agents.data_source_scan(texts, known).collect()} == {"/b.json": 13, "/c.md": 2503}
    entries = spark.createDataFrame([("b", False), (".x", False), ("z", True), ("node_modules", True)], "name string, is_dir boolean")
    assert [r.name for r in agents.listing(entries).collect()] == ["z", "b"]
