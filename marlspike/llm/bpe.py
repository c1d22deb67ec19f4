"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text of up to ``CHUNK`` code points is encoded where it lies. A longer one is cut into chunks that overlap, which are
dealt to tasks of their own. Each chunk is split into pre-tokens from its start, wherever that falls. What a pattern
without look-behind matches from a place on depends only on what follows, so once two neighbours have a boundary in
common within their overlap, they agree from there on: there the text is cut. Only boundaries after a visible character
are taken, as what white space matches depends on what comes behind it, and none of the last ``REACH`` code points of a
chunk, as what the pattern matches there may go on. Where neighbours don't agree (a pre-token longer than the overlap),
the rest of the text goes round again in chunks and overlaps ``WIDER`` times as long, so that the ids are those of the
whole text in any case. Pieces are encoded in parallel and joined in order. Decoding concatenates the bytes of the ids.

Null and empty texts have no ids. Repeated rows are encoded as often as they occur, rows without a doc_id, too. Strings
of special tokens are ordinary text. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import base64
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, broadcast_if_small, held_by_worker, schema, slices

CHUNK = 32_768
OVERLAP = 1024
WIDER = 8
#: Rows of places that may be sent to every task; more are joined by a shuffle.
MOST_SHIPPED = 500_000
#: Code points behind a place that a match up to there may depend on: the rest of a literal of three, and one to look ahead.
REACH = 3


class Codec:
    """Ids and bytes by a file of ranks (a token in base 64 and its rank per line)."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def ends(self, text: str) -> np.ndarray:
        """Where pre-tokens end that end with a visible character."""
        return np.array([m.end() for m in self.pattern.finditer(text) if not m.group()[-1].isspace()], np.int32)


def _codec(path: str, pattern: str) -> Codec:
    return held_by_worker(("bpe", path, pattern), lambda: Codec(path, pattern))


def _encoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows with ids in place of text."""
    kept = [f.name for f in rows.schema.fields if f.name != "text"]
    kind = rows.drop("text").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        codec = _codec(path, pattern)
        for batch in slices(batches, 500):
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            at = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            lists = pa.LargeListArray.from_arrays(at, np.concatenate(ids)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), lists], names=[*kept, "ids"])

    return rows.mapInArrow(run, kind)


def chunked(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """rows (key, doc_id, base, text) as k, text: chunk k of a text begins at k * chunk and reaches ``overlap`` into the next one."""

    def run(batches):
        for batch in slices(batches, 1):
            key, doc, base, text = (batch.column(c)[0].as_py() for c in ("key", "doc_id", "base", "text"))
            starts = range(0, len(text), chunk)
            for some in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                columns = [[key] * len(some), [doc] * len(some), [base] * len(some), [s // chunk for s in some], [text[s : s + chunk + overlap] for s in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())], names=["key", "doc_id", "base", "k", "text"])

    return rows.mapInArrow(run, schema("key long, doc_id long, base long, k long, text string"))


def _boundaries(chunks: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key, k, and where pre-tokens end in the overlap with the chunk before (head) and the next one (tail), from that chunk's start on."""

    def run(batches):
        codec = _codec(path, pattern)
        for batch in slices(batches, 100):
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                ends = codec.ends(text)
                heads.append([0, *ends[ends <= overlap].tolist()])
                tails.append((ends[(ends >= chunk) & (ends <= len(text) - REACH)] - chunk).tolist())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(heads, kind), pa.array(tails, kind)], names=["key", "k", "head", "tail"])

    return chunks.mapInArrow(run, schema("key long, k long, head array<int>, tail array<int>"))


def stitched(boundaries: DataFrame, chunk: int) -> DataFrame:
    """key, k, start and length (null: to the end) of the chunk's own part, and open: whether it lies behind the last place known to be a boundary of the text.

    A boundary that two chunks share is one of the text only if the first of them follows the text there, so the first
    pair of chunks without any leaves all that follows open, from the start of that pair's first part on.
    """
    order = Window.partitionBy("key").orderBy("k")
    cut = boundaries.select("key", "k", F.array_min(F.array_intersect(F.lag("tail").over(order), "head")).alias("cut"))
    lost = F.min(F.when((F.col("k") > 0) & F.col("cut").isNull(), F.col("k"))).over(Window.partitionBy("key"))
    both = cut.select("*", F.lead("k").over(order).isNotNull().alias("more"), F.lead("cut").over(order).alias("next"), lost.alias("lost"))
    start = F.when(F.col("lost").isNull() | (F.col("k") < F.col("lost")), F.coalesce("cut", F.lit(0))).otherwise(0)
    end = chunk + F.when(F.col("lost").isNull() | (F.col("k") + 1 < F.col("lost")), F.coalesce("next", F.lit(0))).otherwise(0)
    return both.select("key", "k", start.alias("start"), F.when(F.col("more"), end - start).alias("length"), F.coalesce(F.col("k") + 1 >= F.col("lost"), F.lit(False)).alias("open"))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text)."""
    if not REACH < overlap <= chunk:
        raise ValueError(f"the overlap must be more than {REACH} and no longer than a chunk")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = _encoded(rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk), path, pattern)

    scratch = Scratch(docs.sparkSession, "bpe")
    left = rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("key"), "doc_id", F.lit(0).cast("long").alias("base"), "text")
    found: list[DataFrame] = []
    while True:
        chunks = scratch.keep(chunked(left, chunk, overlap).repartition("key", "k"), "chunks")
        parts = scratch.keep(stitched(_boundaries(chunks, path, pattern, chunk, overlap), chunk), "parts")
        placed = chunks.join(broadcast_if_small(parts, MOST_SHIPPED), ["key", "k"])
        text = F.substring("text", F.col("start") + 1, F.coalesce("length", F.length("text")))
        placed = placed.select("key", "doc_id", (F.col("base") + F.col("k")).alias("piece"), "open", text.alias("text"))
        found.append(_encoded(placed.where("NOT open").drop("open"), path, pattern))
        if parts.where("open").isEmpty():
            break
        rest = placed.where("open").groupBy("key", "doc_id").agg(F.min("piece").alias("base"), F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"))
        left = scratch.keep(rest.select("key", "doc_id", "base", F.array_join("parts.text", "").alias("text")), "left")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    pieces = reduce(DataFrame.unionByName, found)
    whole = pieces.groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    return short.unionByName(whole.select("doc_id", F.flatten("pieces.ids").alias("ids")))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows with ids, and with the bytes that they stand for in ``decoded``; null ids stay null."""
    kind = encoded.schema
    names = [n for n in kind.names if n != "decoded"]

    def run(batches):
        codec = _codec(path, pattern)
        for batch in slices(batches, 500):
            decoded = [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(decoded, pa.binary())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, encoded.select(*names).schema.add("decoded", T.BinaryType()))
