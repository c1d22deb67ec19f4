"""The event workload as Structured Streaming: keyed debounce with state, last-seen, windows in event time, retries per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events as ops
from ..sources.folders import write_whole

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files of events as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def file_kind(event_type: str = "event_type"):
    """Which change of a file an event stands for; null for events that are not watched."""
    column = F.col(event_type)
    return F.when(column == "signup", "file_created").when(column.isin("click", "view"), "file_modified").when(column == "error", "file_deleted")


def debounce(events: DataFrame, seconds: float, key: str = "user_id", late: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """Accepted events, the first at once. The state of a key is the time it last accepted; it goes when nothing has come for so long."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        taken = []
        for at, event in zip(rows["ts"], rows["event_id"]):
            seen = at.value / 1e9
            if last is None or seen - last >= seconds:
                taken.append((group[0], event, at))
                last = seen
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + int(pd.Timedelta(keep).total_seconds() * 1000))
        yield pd.DataFrame(taken, columns=["key", "event_id", "ts"])

    watched = events.withWatermark("ts", late).select(F.col(key).alias("key"), "event_id", "ts")
    return watched.groupBy("key").applyInPandasWithState(run, "key long, event_id long, ts timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def last_seen(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The latest event per key, in update mode."""
    return events.groupBy(F.col(key).alias("key")).agg(F.max("ts").alias("last_seen"))


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: events by kind per window of event time."""
    slots = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(slots.alias("slot"), "event_type").agg(F.count("*").alias("n"))


def bursts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Extension: sessions of a key, apart by gaps."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("slot"), key).agg(F.count("*").alias("n"))


def write_once(rows: DataFrame, folder: str, epoch: int) -> bool:
    """Writes the rows of an epoch as Parquet to ``folder/epoch=N``, which appears as a whole; does nothing, rows not even computed, if it is there."""
    return write_whole(rows, folder, f"epoch={epoch}")


def agent_files(spark: SparkSession, path: str, processed: str, files_a_trigger: int = 100) -> DataFrame:
    """path and content of files that agents put into their folders, each once; files that were read move to ``processed``."""
    files = spark.readStream.schema("value string").option("wholetext", "true").option("cleanSource", "archive").option("sourceArchiveDir", processed)
    rows = files.option("maxFilesPerTrigger", files_a_trigger).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("content"))


def watch_agents(files: DataFrame, root: str, out: str, checkpoint: str, **trigger):
    """A query that writes the events of agents' files to ``out``, a folder per epoch, no epoch twice."""
    write = lambda rows, epoch: write_once(ops.agent_outputs(rows, root), out, epoch)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upload(events: DataFrame, send: Callable[[DataFrame, int], None], log: str, checkpoint: str, retries: int = 3):
    """A query that sends each batch, tries again, and appends what happened to a Parquet log. A batch that fails for good is logged and passed over."""

    def run(batch: DataFrame, epoch: int) -> None:
        failures = 0
        for _ in range(retries):
            try:
                send(batch, epoch)
                break
            except Exception:
                failures += 1
        done = batch.select("event_id", F.lit(epoch).alias("epoch"), F.lit(failures).alias("failures"), F.lit("failed" if failures == retries else "uploaded").alias("status"))
        done.write.mode("append").parquet(log)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
