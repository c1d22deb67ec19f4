"""Ranked lexical search with block-max pruning.

Documents are indexed in blocks of consecutive ones. A block holds its terms, for each the documents of the block with
the term's impact there (what it adds to a score for each unit of the term's weight), and the term's largest impact in
the block. The weighted sum of these maxima over an item's terms bounds the scores of all documents of a block.

A search first orders the blocks of each item by their bounds and scores the ``FIRST`` best of all; the k-th score found
there is the threshold. Then each task goes through its blocks, those with the highest bounds first, and scores a block
for the items whose threshold its bound reaches, while better documents raise the task's own threshold. A block whose
bound lies below the threshold can't hold one of the k best, so the result is exact, ties included.

The index is a stored table, made by maps over the documents without any shuffle. Items are dealt into shards of bounded
size, each of which is sent to all tasks; a search returns k rows per item and task at most.

Null and empty texts are no documents for the statistics and are never found. Rows are documents: repeated ones count
and are found as often as they occur; of equal scores the smaller doc_id comes first, null ones last. Rows of one item_id
(null, too) are one item with the terms of all. Items without a term that occurs find nothing. Empty tables give empty
tables. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, schema, slices
from .decontamination import FOLDED

K = 10
FIRST = 4
#: Documents of a block, and bytes of text after which it ends before.
BLOCK = 32
BLOCK_BYTES = 1 << 20
#: Blocks that a task orders and scores at a time.
WINDOW = 32
SHARD_ITEMS = 4096
SHARD_BYTES = 16 << 20

#: Numbers and terms of a block travel as bytes: ids apart, they are of no use to Spark. term_ends: where each term ends in
#: terms; ends: where its documents end in docs (places in ids) and in impacts.
INDEX = "block long, ids array<long>, terms binary, term_ends binary, top binary, ends binary, docs binary, impacts binary"
PLACE, NUMBER = np.dtype("u1"), np.dtype("<i4")
BOUNDS = "item int, block long, bound long"
SCORES = "item int, doc_id long, score long"
#: In place of a null id in comparisons.
LAST = 1 << 63


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs so often in documents of these lengths adds for each unit of its weight."""
    normal = 10 + (90 * lengths * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 8 * normal)


@dataclass
class Index:
    """blocks as in INDEX; how many documents have terms, and how many terms all of them have."""

    blocks: DataFrame
    documents: int
    total: int


def _block(number: int, ids: list, texts: list[list[bytes]], documents: int, total: int) -> pa.RecordBatch:
    terms: dict[bytes, int] = {}
    places, docs, counts = [], [], []
    for i, words in enumerate(texts):
        found = Counter(words)
        places += [terms.setdefault(w, len(terms)) for w in found]
        docs += [i] * len(found)
        counts += found.values()
    place, doc = np.array(places, np.int64), np.array(docs, np.int64)
    by_term = np.argsort(place, kind="stable")
    lengths = np.array([len(w) for w in texts], np.int64)
    impacts = impact(np.array(counts, np.int64), lengths[doc], documents, total)[by_term]
    ends = np.cumsum(np.bincount(place, minlength=len(terms)))
    top = np.maximum.reduceat(impacts, np.concatenate([[0], ends[:-1]])) if len(terms) else impacts
    numbers = {"term_ends": np.cumsum([len(t) for t in terms]), "top": top, "ends": ends, "impacts": impacts}
    row = {"block": number, "ids": ids, "terms": b"".join(terms), "docs": doc[by_term].astype(PLACE).tobytes()} | {c: v.astype(NUMBER).tobytes() for c, v in numbers.items()}
    kinds = {"block": pa.int64(), "ids": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict({c: pa.array([row[c]], kinds.get(c, pa.binary())) for c in (f.split()[0] for f in INDEX.split(", "))})


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and how many terms all of them have: the sums that every impact needs, by a scan of its own."""

    def run(batches):
        n = total = 0
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                found = len((text.as_py() or b"").translate(FOLDED).split())
                n, total = n + bool(found), total + found
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    found = docs.select("text").mapInArrow(run, schema("n long, total long"))
    return tuple(found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first())


def _blocks(docs: DataFrame, block: int, documents: int, total: int) -> DataFrame:
    """Blocks of consecutive documents of a partition."""

    def run(batches):
        number, size = TaskContext.get().partitionId() << 33, 0
        ids: list = []
        texts: list[list[bytes]] = []
        for batch in slices(batches, 200):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                text = text or b""
                ids.append(doc)
                texts.append(text.translate(FOLDED).split())
                size += len(text)
                if len(ids) == block or size >= BLOCK_BYTES:
                    yield _block(number, ids, texts, documents, total)
                    number, size, ids, texts = number + 1, 0, [], []
        if ids:
            yield _block(number, ids, texts, documents, total)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema(INDEX))


def _numbers(batch: pa.RecordBatch, column: str, row: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def build(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> Index:
    """The index of docs (doc_id, text), a stored table."""
    if not 0 < block <= 256:
        raise ValueError("a block holds 1 to 256 documents")
    n, total = statistics(docs)
    return Index(scratch.keep(_blocks(docs, block, n, max(1, total)), "index"), n, total)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each."""

    def run(batches):
        for batch in batches:
            found = [sorted(set((t or b"").translate(FOLDED).split())) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([[w.decode() for w in ws] for ws in found], pa.list_(pa.string()))], names=["item_id", "terms"])

    rows = items.select("item_id", "text")
    found = rows.mapInArrow(run, T.StructType([rows.schema["item_id"]]).add("terms", T.ArrayType(T.StringType())))
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def _frequencies(blocks: DataFrame, terms: list[str]) -> dict[str, int]:
    """How many documents hold each of the terms of a shard, for those that occur: a count per term and task, then their sums."""
    shared = blocks.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted = pa.array([t.encode() for t in shared.value], pa.binary())
        held = np.zeros(len(wanted), np.int64)
        for batch in slices(batches, WINDOW):
            found, at = _terms(batch, wanted)
            ends = np.concatenate([np.diff(_numbers(batch, "ends", r, NUMBER), prepend=0) for r in range(batch.num_rows)])
            np.add.at(held, found[found >= 0], ends[found >= 0])
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["term", "held"])

    found = blocks.select("terms", "term_ends", "ends").mapInArrow(run, schema("term long, held long"))
    return {terms[r.term]: r.held for r in found.groupBy("term").agg(F.sum("held").alias("held")).collect()}


def _terms(batch: pa.RecordBatch, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For all terms of some blocks their place in ``wanted`` or -1, and where each block's terms begin and end."""
    ends = [_numbers(batch, "term_ends", r, NUMBER) for r in range(batch.num_rows)]
    data = b"".join(batch.column("terms").to_pylist())
    sizes = np.concatenate([np.diff(e, prepend=0) for e in ends]) if ends else np.zeros(0, NUMBER)
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64).tobytes())
    terms = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(data)])
    found = pc.index_in(terms, value_set=wanted.cast(pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False)
    return found, np.cumsum([0, *map(len, ends)])


class Query:
    """The items of a shard: their terms with weights, term by term."""

    def __init__(self, weights: list[dict[str, int]], k: int):
        self.items, self.k = len(weights), k
        by_term: dict[str, list[tuple[int, int]]] = {}
        for i, held in enumerate(weights):
            for term, w in held.items():
                if w > 0:
                    by_term.setdefault(term, []).append((i, w))
        self.terms = list(by_term)
        self.ends = np.cumsum([0, *map(len, by_term.values())])
        pairs = [p for ps in by_term.values() for p in ps]
        self.item, self.weight = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))

    def entries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For terms at these places of ``terms``: which of them, the items and the weights."""
        which, at = _ranges(self.ends[places], self.ends[places + 1])
        return which, self.item[at], self.weight[at]


def _ranges(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and to which range each belongs."""
    sizes = ends - begins
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[which]


class Span:
    """Some blocks side by side, and what a query's terms find there."""

    def __init__(self, batch: pa.RecordBatch, query: Query, wanted: pa.Array):
        self.batch, self.query = batch, query
        found, at = _terms(batch, wanted)
        self.place = np.flatnonzero(found >= 0)  # among all terms of the blocks
        self.row = np.searchsorted(at, self.place, side="right") - 1
        self.local = self.place - at[self.row]
        self.which, self.item, self.weight = query.entries(found[self.place])

    def bounds(self) -> np.ndarray:
        """Of each block (rows) for each item (columns)."""
        top = np.concatenate([_numbers(self.batch, "top", r, NUMBER) for r in range(self.batch.num_rows)])[self.place].astype(np.int64)
        out = np.zeros(self.batch.num_rows * self.query.items, np.int64)
        np.add.at(out, self.row[self.which] * self.query.items + self.item, self.weight * top[self.which])
        return out.reshape(self.batch.num_rows, -1)

    def scores(self, row: int, items: np.ndarray) -> np.ndarray:
        """Of each document of a block (rows) for some items (columns)."""
        lo, hi = np.searchsorted(self.row, [row, row + 1])
        lo_entry, hi_entry = np.searchsorted(self.which, [lo, hi])
        column = np.full(self.query.items, -1)
        column[items] = np.arange(len(items))
        mine = column[self.item[lo_entry:hi_entry]] >= 0
        which, item, weight = (x[lo_entry:hi_entry][mine] for x in (self.which, self.item, self.weight))
        ends, docs, impacts = (_numbers(self.batch, c, row, k) for c, k in (("ends", NUMBER), ("docs", PLACE), ("impacts", NUMBER)))
        local = self.local[which]
        entry, at = _ranges(np.where(local > 0, ends[local - 1], 0), ends[local])
        size = len(self.batch.column("ids")[row])
        out = np.zeros(size * len(items), np.int64)
        np.add.at(out, docs[at].astype(np.int64) * len(items) + column[item[entry]], weight[entry] * impacts[at].astype(np.int64))
        return out.reshape(size, -1)


def _windows(batches, query: Query, most: int):
    wanted = pa.array([t.encode() for t in query.terms], pa.binary())
    for batch in slices(batches, most):
        yield Span(batch, query, wanted)


def best_blocks(blocks: DataFrame, query, first: int) -> DataFrame:
    """The blocks with the highest bounds of each item, a task's own first, then those of all tasks."""

    def run(batches):
        q = query.value
        best = np.zeros((0, q.items), np.int64)
        names = np.zeros((0, q.items), np.int64)
        for w in _windows(batches, q, WINDOW):
            best = np.concatenate([best, w.bounds()])
            names = np.concatenate([names, np.repeat(w.batch.column("block").to_numpy()[:, None], q.items, axis=1)])
            order = np.argsort(-best, axis=0, kind="stable")[:first]
            best, names = np.take_along_axis(best, order, axis=0), np.take_along_axis(names, order, axis=0)
        at, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(names[at, item], pa.int64()), pa.array(best[at, item], pa.int64())], names=["item", "block", "bound"])

    found = blocks.select("block", "terms", "term_ends", "top").mapInArrow(run, schema(BOUNDS))
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).drop("place")


def scored(blocks: DataFrame, query, least: np.ndarray) -> DataFrame:
    """The best documents of each task for each item: those with a score of at least the item's threshold."""

    def run(batches):
        q, floor = query.value, np.maximum(least, 1)
        tops: list[list] = [[] for _ in range(q.items)]
        for w in _windows(batches, q, WINDOW):
            bounds = w.bounds()
            for row in np.argsort(-(bounds / floor).max(axis=1, initial=0), kind="stable"):
                items = np.flatnonzero(bounds[row] >= floor)
                if not len(items):
                    continue
                scores = w.scores(int(row), items)
                bar = floor[items]
                if len(scores) > q.k:
                    bar = np.maximum(bar, np.partition(scores, -q.k, axis=0)[-q.k])
                ids = w.batch.column("ids")[int(row)].as_py()
                for doc, column in zip(*(x.tolist() for x in np.nonzero(scores >= bar))):
                    item = int(items[column])
                    heap, key = tops[item], (int(scores[doc, column]), -(LAST if ids[doc] is None else ids[doc]))
                    if len(heap) < q.k:
                        heapq.heappush(heap, key)
                    elif key > heap[0]:
                        heapq.heapreplace(heap, key)
                    if len(heap) == q.k:
                        floor[item] = max(floor[item], heap[0][0])
        rows = [(i, None if -d == LAST else -d, s) for i, heap in enumerate(tops) for s, d in heap]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return blocks.mapInArrow(run, schema(SCORES))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _shards(terms: DataFrame, items: int, size: int) -> int:
    """How many shards keep each within the limits, unless it is a single item."""
    loads = terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 16).alias("size"))
    count, total = loads.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-count // items), -(-total // size))
    while 1 < parts < count:
        worst = loads.groupBy(_shard(parts)).agg(F.count("*").alias("items"), F.sum("size").alias("size"))
        if not worst.where((F.col("items") > F.greatest(F.lit(items), F.lit(1))) | ((F.col("size") > size) & (F.col("items") > 1))).limit(1).count():
            break
        parts *= 2
    return parts


def _shard(parts: int):
    return F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(parts))


def search(index: Index, items: DataFrame, scratch: Scratch, k: int = K, first: int = FIRST, shard_items: int = SHARD_ITEMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item (item_id, text)."""
    spark = items.sparkSession
    kind = T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]])
    terms = scratch.keep(item_terms(items), "items")
    parts = _shards(terms, shard_items, shard_bytes)
    found: list[DataFrame] = []
    for part in range(parts):
        held: dict = {}
        for r in terms.where(_shard(parts) == part).collect():
            held.setdefault(r.item_id, []).append(r.term)
        holding = _frequencies(index.blocks, sorted({t for ts in held.values() for t in ts}))
        weights = {item: {t: weight(index.documents, holding[t]) for t in ts if t in holding} for item, ts in held.items()}
        query = spark.sparkContext.broadcast(Query(list(weights.values()), k))
        chosen = best_blocks(index.blocks, query, first).select("block").distinct()
        start = ranked(scored(index.blocks.join(F.broadcast(chosen), "block"), query, np.zeros(len(weights), np.int64)), k)
        least = np.zeros(len(weights), np.int64)
        for r in start.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect():
            least[r.item] = r.least
        names = F.broadcast(spark.createDataFrame(list(enumerate(weights)), kind))
        top = ranked(scored(index.blocks, query, least), k).join(names, "item")
        found.append(scratch.keep(top.select("item_id", "rank", "doc_id", "score"), "found"))
    return reduce(DataFrame.unionByName, found)
