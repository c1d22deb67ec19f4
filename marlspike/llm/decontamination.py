"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, each text scanned once.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and characters beyond ASCII. A window is
``n`` consecutive words of an item, or all words of a shorter one. Each distinct benchmark word is a symbol of the
automaton and every other word is one foreign symbol, so that a text is scanned as a string of one symbol per word
and windows never start or end inside a word. A symbol is one character, or, of more than ``ONE_CHARACTER`` words, two
of disjoint alphabets, so that matches begin at a word there, too. Matches are word positions; for the texts that have any, they are
mapped back to code points of the original text.

The benchmark goes to every task. Its size is measured first; beyond ``SHARD_BYTES`` it is dealt into shards of at
most that size, one scan each, and the matches of a document are joined over the shards. The driver holds one shard at
a time.

Null and empty texts and items have no words; documents without a doc_id are scanned like others, items without an id aren't. Items without words match nothing. Repeated item ids count once,
repeated documents are reported once each. Empty tables give empty tables or no matches. Other columns are kept.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, held_by_worker, schema, slices

WINDOW = 10
#: Bytes of items that one automaton holds. A megabyte of items of 35 words takes about 120 MB in a worker, so a shard stays below 500 MB.
SHARD_BYTES = 4 << 20
#: Distinct words of one automaton up to which a character is enough.
ONE_CHARACTER = 1_000_000
FOREIGN = "\x01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of UTF-8: A-Z in lower case, all others that are no part of a word as spaces.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLDED).split()


class Automaton:
    """All windows of the given items; hits() finds them in a list of words."""

    def __init__(self, items: Iterable[tuple[str, str | None]], n: int, one_character: int = ONE_CHARACTER):
        import ahocorasick

        items = list(items)
        distinct = dict.fromkeys(w for _, text in items for w in words(text))
        self.width = 1 if len(distinct) <= one_character else 2
        self.symbols = {w: self._symbol(i) for i, w in enumerate(distinct)}
        self.foreign = FOREIGN * self.width
        owners: dict[str, set[str]] = {}
        for item, text in items:
            symbols = [self.symbols[w] for w in words(text)]
            for at in range(max(1, len(symbols) - n + 1) if symbols else 0):
                owners.setdefault("".join(symbols[at : at + n]), set()).add(item)
        self.search = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.search.add_word(window, (len(window) // self.width, tuple(ids)))
        self.any = bool(owners)
        if self.any:
            self.search.make_automaton()

    def _symbol(self, i: int) -> str:
        """Without surrogates; a pair is one of 0x4000 characters and one of those beyond U+FFFF."""
        if self.width == 1:
            return chr(2 + i if 2 + i < 0xD800 else 2 + i + 0x800)
        return chr(2 + i % 0x4000) + chr(0x10000 + i // 0x4000)

    def hits(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint ranges of hit words, in order, and the items whose windows occur."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.any:
            symbol = self.symbols.get
            for end, (length, ids) in self.search.iter("".join([symbol(w, self.foreign) for w in text_words])):
                items.update(ids)
                end //= self.width
                start = end + 1 - length
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append((start, end + 1))
        return ranges, items


def shards(benchmark: DataFrame, limit: int = SHARD_BYTES) -> tuple[int, Callable[[int], list[tuple[str, str | None]]]]:
    """How many parts of about the limit at most the items make, and what collects one of them; a single item may be larger."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    parts = -(-size * 2 // limit) if size > limit else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return parts, lambda i: [(r.item_id, r.text) for r in rows.where(part == i).collect()]


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items and spans: code points [start, end) of runs of hit words in the original text.

    Columns of docs with one of these names give way.
    """
    docs = docs.drop(*(f.name for f in schema(HITS).fields))
    parts, part = shards(benchmark, limit)
    scratch = Scratch(docs.sparkSession, "decontamination") if parts > 1 else None
    out = docs.withColumns({"items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:int,end:int>>")})
    for k in range(parts):
        out = _scan(out, part(k), n, k == parts - 1)
        if k < parts - 1:
            out = scratch.keep(out.drop("n_words", "n_hit"), "shard")
    return out


def _scan(docs: DataFrame, part: list[tuple[str, str | None]], n: int, last: bool) -> DataFrame:
    """Add a shard's matches to ``items`` and, as positions of words, to ``spans``; the last scan turns those into code points."""
    own = [f for f in docs.schema.fields if f.name not in ("items", "spans")]
    out = T.StructType([*own, *schema(HITS).fields])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    shared, key = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

    def run(batches):
        automaton = held_by_worker(key, lambda: Automaton(shared.value, n))
        for batch in slices(batches):
            counts, hit, items, spans = [], [], [], []
            earlier = zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), batch.column("spans").to_pylist())
            for text, known, before in earlier:
                text_words = words(text)
                ranges, owners = automaton.hits(text_words)
                if before:
                    ranges = _joined(sorted([*ranges, *((r["start"], r["end"]) for r in before)]))
                counts.append(len(text_words))
                hit.append(sum(e - s for s, e in ranges))
                items.append(sorted(owners.union(known)))
                spans.append(_original(text, ranges) if last and ranges else [{"start": s, "end": e} for s, e in ranges])
            arrays = [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *arrays], names=out.fieldNames())

    return docs.mapInArrow(run, out)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in ranges:
        if out and out[-1][1] >= s:
            s, e = out[-1][0], max(e, out.pop()[1])
        out.append((s, e))
    return out


def _original(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[s][0], "end": places[e - 1][1]} for s, e in ranges]


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = SHARD_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns; their texts go to Python once."""
    parts, part = shards(benchmark, limit)
    scratch = Scratch(docs.sparkSession, "decontamination") if parts > 1 else None
    for k in range(parts):
        docs = _without(docs, part(k), n)
        if k < parts - 1:
            docs = scratch.keep(docs, "shard")
    return docs


def _without(docs: DataFrame, part: list[tuple[str, str | None]], n: int) -> DataFrame:
    """The documents without a match of a shard."""
    shared, key = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches):
        automaton = held_by_worker(key, lambda: Automaton(shared.value, n))
        for batch in slices(batches):
            yield batch.filter(pa.array([not automaton.hits(words(t))[0] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
