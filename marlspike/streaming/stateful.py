"""Keyed state that outlives batches: cooldown after completions, and delivery in order with back-off.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), as they keep several kinds of state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .pipelines import write_once

ANSWERS = "key long, batch long, attempt int, kind string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cooldown(StatefulProcessor):
    """Events and completions of a key in order of time; an event counts unless a completion lies less than ``seconds`` before it.

    Rows wait until the watermark has passed them, so that what arrives late but in time is still put in order. The last
    completion is forgotten when nothing can fall into its time any more.
    """

    def __init__(self, seconds: float):
        self.micros = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event long, done boolean")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(a), int(e), bool(d)) for a, e, d in zip(micros, part["event_id"], part["done"])])
            for at in sorted({a // 1000 + 1 for a in micros}):
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        last = self.last.get()[0] if self.last.exists() else None
        taken = []
        for at, event, done in sorted((r for r in rows if r[0] < now), key=lambda r: (r[0], not r[2], r[1])):
            if done:
                last = at
            elif last is None or (at - last) // 1_000_000 * 1_000_000 >= self.micros:
                taken.append((key[0], event, pd.Timestamp(at, unit="us")))
        left = [r for r in rows if r[0] >= now]
        if len(left) < len(rows):
            self.waiting.put(left) if left else self.waiting.clear()
        if last is not None and last + self.micros + 1_000_000 > now:
            self.last.update((last,))
            self.handle.registerTimer((last + self.micros) // 1000 + 1001)
        elif self.last.exists():
            self.last.clear()
        if taken:
            yield pd.DataFrame(taken, columns=["key", "event_id", "ts"])

    def close(self) -> None:
        pass


def cooldown(events: DataFrame, completions: DataFrame, seconds: float, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Events (ts, event_id and a key) that don't fall into the cooldown after a completion of their key; those that do are dropped, not deferred."""
    pick = lambda rows, done: rows.select(F.col(key).cast("long").alias("key"), "ts", "event_id", F.lit(done).alias("done"))
    both = pick(events, False).unionByName(pick(completions, True)).withWatermark("ts", late)
    return both.groupBy("key").transformWithStateInPandas(Cooldown(seconds), "key long, event_id long, ts timestamp", "Append", "EventTime")


class Delivery(StatefulProcessor):
    """A queue per key. At most one batch of a key is under way; the next one leaves when it was answered, a failed one again after its delay.

    Input rows are items (``kind`` item) or answers (ok, failed) to a batch by its number. Output rows are what is to be
    sent now: key, batch, attempt and the item. Beyond ``retries`` tries a batch is given up (attempt -1).
    """

    def __init__(self, size: int, retries: int, base: float, most: float):
        self.size, self.retries, self.base, self.most = size, retries, base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "at long, item long")
        self.sent = handle.getListState("sent", "at long, item long")
        self.state = handle.getValueState("state", "batch long, attempt int, waits boolean")

    def _now(self) -> tuple[int, int, bool]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, False)

    def _rows(self, key, batch: int, attempt: int, items: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], batch, attempt, i) for _, i in items], columns=["key", "batch", "attempt", "item"])

    def _next(self, key, batch: int) -> pd.DataFrame:
        """The next items leave; without any the key rests."""
        items = sorted(tuple(r) for r in self.queue.get())
        self.sent.clear()
        if not items:
            self.state.update((batch, 0, False))
            return self._rows(key, batch, 0, [])
        first, rest = items[: self.size], items[self.size :]
        self.queue.put(rest) if rest else self.queue.clear()
        self.sent.put(first)
        self.state.update((batch + 1, 1, True))
        return self._rows(key, batch + 1, 1, first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        answers: list[tuple[int, int, bool]] = []
        for part in rows:
            items = part[part["kind"] == "item"]
            if len(items):
                self.queue.appendList([(int(a), int(i)) for a, i in zip(items["at"], items["item"])])
            other = part[part["kind"] != "item"]
            answers += [(int(b), int(n), k == "ok") for b, n, k in zip(other["batch"], other["attempt"], other["kind"])]
        out = []
        for number, attempt, ok in sorted(answers):
            batch, tries, waits = self._now()
            if (number, attempt) != (batch, tries) or not waits:
                continue  # answered before
            if ok:
                out.append(self._next(key, batch))
            elif tries > self.retries:
                out.append(self._rows(key, batch, -1, [tuple(r) for r in self.sent.get()]))
                out.append(self._next(key, batch))
            else:
                delay = min(self.most, self.base * 2 ** (tries - 1))
                self.state.update((batch, tries, False))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * delay))
        batch, tries, waits = self._now()
        if not waits and not self.sent.exists():
            out.append(self._next(key, batch))
        yield from (rows for rows in out if len(rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch, tries, waits = self._now()
        if waits or not self.sent.exists():
            return
        self.state.update((batch, tries + 1, True))
        yield self._rows(key, batch, tries + 1, [tuple(r) for r in self.sent.get()])

    def close(self) -> None:
        pass


def queued(items: DataFrame, answers: DataFrame, size: int = 10, retries: int = 3, base: float = 1.0, most: float = 60.0) -> DataFrame:
    """What is to be sent: items (key, at, item) in order, ``size`` at a time, each batch until an answer (key, batch, attempt, kind: ok or failed) says that it arrived."""
    none = lambda kind: F.lit(None).cast(kind)
    a = items.select("key", F.lit("item").alias("kind"), "at", "item", none("long").alias("batch"), none("int").alias("attempt"))
    b = answers.select("key", "kind", none("long").alias("at"), none("long").alias("item"), "batch", "attempt")
    kind = "key long, batch long, attempt int, item long"
    return a.unionByName(b).groupBy("key").transformWithStateInPandas(Delivery(size, retries, base, most), kind, "Append", "ProcessingTime")


def deliver(outgoing: DataFrame, send: Callable[[int, int, int, list[int]], bool], answers: str, checkpoint: str, every: str = "1 second"):
    """A query that sends the batches of :func:`queued` and writes the answers where that reads them (see :func:`read_answers`).

    An epoch whose answers are there was sent: it isn't sent again after a restart. A crash between sending and answering
    repeats the epoch's batches with the same key, batch and attempt, by which a receiver can tell them. Batches that
    were given up are not sent; they stay in the output with attempt -1.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        key, batch, attempt = (int(group[c].iloc[0]) for c in ("key", "batch", "attempt"))
        ok = bool(send(key, batch, attempt, group["item"].tolist()))
        return pd.DataFrame([(key, batch, attempt, "ok" if ok else "failed")], columns=["key", "batch", "attempt", "kind"])

    def run(rows: DataFrame, epoch: int) -> None:
        groups = rows.where("attempt > 0").groupBy("key", "batch", "attempt")
        write_once(groups.applyInPandas(one, ANSWERS), answers, epoch)

    return outgoing.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def read_answers(spark: SparkSession, answers: str) -> DataFrame:
    """The answers that deliver() wrote, as a stream."""
    return spark.readStream.schema(ANSWERS).parquet(answers)
