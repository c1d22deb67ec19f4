"""Streams against their batch forms, with late rows, failures and restarts."""

import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlspike.operators import events
from marlspike.streaming import pipelines, stateful, watch

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.ROCKS)
    yield spark
    spark.conf.set(name, before)


def run(rows, name, checkpoint):
    query = rows.writeStream.format("parquet").option("path", name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_cooldown_as_a_stream(rocks, tmp_path):
    """Replayed in files by time, some rows a file too late, with a restart in the middle."""
    source = rocks.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 40").orderBy("ts", "event_id").limit(1500).toPandas()
    share = [i * 5 / len(source) for i in range(len(source))]
    place = [min(4, int(x) + (x % 1 > 0.9 and i % 3 == 0)) for i, x in enumerate(share)]
    late = sum(1 for a, b in zip(place, place[1:]) if b < a)
    assert late > 0
    folder = tmp_path / "in"

    def add(n):
        rocks.createDataFrame(source[[p == n for p in place]], pipelines.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))

    def stream():
        rows = pipelines.read_events(rocks, str(folder))
        return stateful.cooldown(rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'"), 7200, late="3 days")

    out = str(tmp_path / "out")
    add(0), time.sleep(1.1), add(1)
    run(stream(), out, str(tmp_path / "c"))
    some = rocks.read.parquet(out).count()
    add(2), time.sleep(1.1), add(3), time.sleep(1.1), add(4)
    time.sleep(1.1)
    end = source.iloc[[-1]].assign(ts=source["ts"].max() + pd.Timedelta("9 days"), event_id=10**9, user_id=10**6)
    rocks.createDataFrame(end, pipelines.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    run(stream(), out, str(tmp_path / "c"))
    got = [(r.key, r.event_id) for r in rocks.read.parquet(out).collect()]
    rows = rocks.createDataFrame(source, pipelines.EVENTS).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("key", F.col("user_id"))
    want = events.cooled(rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'"), 7200)
    assert 0 < some < len(got) and len(got) == len(set(got))
    assert set(got) == {(r.key, r.event_id) for r in want.collect()}


def test_queue_sends_in_order_with_delays_and_nothing_twice(rocks, tmp_path):
    """Key 1 fails twice at its second batch, key 2 is given up once, and the query is stopped and started again."""
    folder, answers, log, c = (str(tmp_path / n) for n in ("in", "answers", "log", "c"))
    os.makedirs(answers), os.makedirs(log)
    items = [(1, i, i) for i in range(25)] + [(2, i, 100 + i) for i in range(3)]
    rocks.createDataFrame(items, "key long, at long, item long").coalesce(1).write.parquet(folder)

    def send(key, batch, attempt, sent):
        with open(f"{log}/{key}-{batch}-{attempt}-{time.time_ns()}", "w") as f:
            json.dump([sent, time.time()], f)
        return not (key == 1 and batch == 2 and attempt <= 2) and not (key == 2 and batch == 1)

    def start():
        rows = rocks.readStream.schema("key long, at long, item long").parquet(folder)
        return stateful.deliver(stateful.queued(rows, stateful.read_answers(rocks, answers), size=10, retries=2, base=0.2), send, answers, c, "100 milliseconds")

    def calls():
        return sorted((json.load(open(f"{log}/{f}"))[1], *map(int, f.split("-")[:3])) for f in os.listdir(log))

    def until(enough, query):
        end = time.time() + 90
        while not enough() and time.time() < end:
            time.sleep(0.2)
        query.stop()

    query = start()
    until(lambda: len(calls()) >= 3, query)
    rocks.createDataFrame([(2, 9, 200)], "key long, at long, item long").coalesce(1).write.mode("append").parquet(folder)
    query = start()
    until(lambda: {c[1:] for c in calls()} >= {(1, 3, 1), (2, 2, 1)}, query)
    done = [c[1:] for c in calls()]
    assert [c for c in done if c[0] == 1] == [(1, 1, 1), (1, 2, 1), (1, 2, 2), (1, 2, 3), (1, 3, 1)]
    assert [c for c in done if c[0] == 2] == [(2, 1, 1), (2, 1, 2), (2, 1, 3), (2, 2, 1)]
    sent = {tuple(map(int, f.split("-")[:3])): json.load(open(f"{log}/{f}"))[0] for f in os.listdir(log)}
    assert sent[(1, 1, 1)] == list(range(10)) and sent[(1, 2, 1)] == sent[(1, 2, 3)] == list(range(10, 20)) and sent[(1, 3, 1)] == list(range(20, 25))
    assert sent[(2, 1, 1)] == [100, 101, 102] and sent[(2, 2, 1)] == [200]
    at = {c[1:]: c[0] for c in calls()}
    assert at[(1, 2, 2)] - at[(1, 2, 1)] >= 0.2 and at[(1, 2, 3)] - at[(1, 2, 2)] >= 0.4


def test_folder_as_a_stream_of_changes(spark, tmp_path):
    spark.dataSource.register(watch.FolderChanges)
    folder = tmp_path / "f"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("1")
    (folder / "sub" / "b.md").write_text("1")

    def told():
        stream = spark.readStream.format("folder_changes").option("path", f"file://{folder}").option("snapshots", str(tmp_path / "s")).load()
        before = {(r.path, r.kind, r.mtime, r.length) for r in spark.read.schema(watch.CHANGES).parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
        query.processAllAvailable()
        query.stop()
        rows = [(r.path, r.kind, r.mtime, r.length) for r in spark.read.schema(watch.CHANGES).parquet(str(tmp_path / "out")).collect()]
        return sorted((os.path.basename(p), k, n) for p, k, t, n in rows if (p, k, t, n) not in before), len(rows)

    assert told() == ([("a.md", "file_created", 1), ("b.md", "file_created", 1)], 2)
    assert told() == ([], 2)
    (folder / "a.md").write_text("22")
    (folder / "sub" / "b.md").unlink()
    (folder / "c.md").write_text("")
    assert told() == ([("a.md", "file_modified", 2), ("b.md", "file_deleted", 1), ("c.md", "file_created", 0)], 5)
    assert told() == ([], 5)
    (folder / "sub" / "b.md").write_text("again")
    assert told() == ([("b.md", "file_created", 5)], 6)


def test_changes_between_listings():
    assert list(watch.changes({"a": (1, 1), "b": (1, 1), "c": (2, 2)}, {"a": (1, 1), "c": (3, 2), "d": (0, 0)})) == [("b", "file_deleted", 1, 1), ("c", "file_modified", 3, 2), ("d", "file_created", 0, 0)]


def test_agents_files_are_read_once_and_moved(spark, tmp_path):
    root = tmp_path / "agents"
    (root / "codex").mkdir(parents=True)
    (root / "codex" / "memory-export.json").write_text(json.dumps({"memories": [{"content": "a"}, {"content": "b"}]}))
    (root / "codex" / "note.md").write_text("text")

    def go():
        files = pipelines.agent_files(spark, str(root), str(tmp_path / "processed"))
        pipelines.watch_agents(files, str(root), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        return sorted((r.agent, r.event_type, r.place) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("codex", "artifact", 0), ("codex", "memory_candidate", 0), ("codex", "memory_candidate", 1)]
    assert go() == first
    assert go() == first
    (root / "codex" / "more.txt").write_text("x")
    assert go() == [("codex", "artifact", 0), *first]
    go()
    moved = [f for _, _, names in os.walk(tmp_path / "processed") for f in names if not f.startswith(".")]
    assert {"memory-export.json", "note.md"} <= set(moved) and not (root / "codex" / "note.md").exists()


def test_an_epoch_is_written_once(spark, tmp_path):
    rows = spark.range(3)
    assert pipelines.write_once(rows, str(tmp_path / "o"), 4) and not pipelines.write_once(spark.range(9), str(tmp_path / "o"), 4)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
