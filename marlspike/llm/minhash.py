"""MinHash near-duplicates by a multi-index Hamming join.

Each text becomes the set of its distinct five-word shingles and, from that, a signature of ``HASHES`` b-bit symbols:
the low 16 bits of a mixed minimum per hash function. Two sets of similarity J differ in a binomial number of
symbols of mean ``HASHES * (1 - J)``. :func:`distance` is the signature distance within which every pair is found:
a pair at the threshold lies beyond it with a probability of less than ``MISSED``, more alike pairs with less still.

Pigeonhole: the symbols are split into so many chunks that twice their number exceeds the distance, so that any pair
within it has a chunk with at most one error. All such errors are enumerated: a key per place of a chunk, made of
the chunk's other symbols. Pairs that share no key are never looked at.

Rows of equal sets count as one (their smallest id) from the start. Then, without emitting all pairs of a group:

1. Buckets of up to ``SMALL_BUCKET`` sets give their pairs; a larger one links each member to its hub, the member
   that shares most keys with others. Links are confirmed on full sets. Most groups are whole after this.
2. What hubs leave apart: only documents of larger buckets that still hold several components are looked at, and only
   pairs of different components. Shingles that more than ``COMMON`` of these documents hold are common, the others
   rare. A pair shares at most as many common shingles as the poorer of both holds, so either that number alone allows a
   link, or the pair shares a rare shingle; by the prefix rule, then, one among the first ``rare - needed + 1`` of each
   in the order of hashes. Pairs of the first kind come from the buckets under that condition, pairs of the second from
   the at most ``COMMON`` holders of a rare shingle. Both are compared on full sets, so no link is lost, and a bucket of
   many sets that are a little less alike than a link costs rows in proportion to its members, not to their square.

Links are exact: ``100 * intersection >= percent * union`` on 64-bit shingle hashes. Texts with fewer than five words
have the whole sequence as their one shingle; null, empty and blank texts have none and are linked with nothing.
Rows without a doc_id link with nothing, have no component and are kept. Repeated rows are copies; a doc_id that occurs with several texts is linked wherever one of them is. Texts are read
whole, however long; their sets travel as 8 bytes a shingle. Empty tables give empty tables. Other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, connected_components, held_by_worker, schema, slices

SHINGLE = 5
#: Of op2_minhash, and of near_duplicates without another.
PERCENT = 85
#: Of deduplicate, as in the pipeline.
STAGE_PERCENT = 80
HASHES = 64
#: Probability at most that a pair at the threshold is farther apart than the distance.
MISSED = 1e-4
SMALL_BUCKET = 16
WORDS_CACHED = 150_000
#: A shingle with more holders among what hubs leave apart is common. It decides the work, never the result.
COMMON = 64
#: Ids that may be sent to every task; more are joined by a shuffle.
MOST_SHIPPED = 500_000


def distance(percent: int, missed: float = MISSED) -> int:
    """The least number of differing symbols that a pair of similarity percent / 100 exceeds with a probability of at most missed."""
    apart, beyond = 0, 1.0
    for apart in range(HASHES):
        beyond -= math.comb(HASHES, apart) * (1 - percent / 100) ** apart * (percent / 100) ** (HASHES - apart)
        if beyond <= missed:
            break
    return apart


def chunks(most_apart: int) -> int:
    """So many chunks that two errors in each are more than most_apart."""
    return most_apart // 2 + 1


MOST_APART = distance(PERCENT)
CHUNKS = chunks(MOST_APART)

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_KEY_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY_SALT = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(held_by_worker("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = out * _STEP + h[j : len(h) - width + 1 + j]
    return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES 16-bit symbols."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (_MUL[:, None] * x[None, at : at + 2048] + _ADD[:, None]).min(axis=1), out=low)
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x7FEB352D)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def keys(signatures: np.ndarray, n_chunks: int = CHUNKS) -> np.ndarray:
    """For each signature a key per symbol: its chunk without that symbol."""
    bounds = np.linspace(0, HASHES, n_chunks + 1).astype(int)
    parts = signatures.astype(np.uint64) * _KEY_MUL
    whole = np.add.reduceat(parts, bounds[:-1], axis=1)
    return _mix(whole[:, np.repeat(np.arange(n_chunks), np.diff(bounds))] - parts + _KEY_SALT).view(np.int64)


def _texts(batch) -> list[bytes]:
    return [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]


def signatures(docs: DataFrame, k: int = SHINGLE, n_chunks: int = CHUNKS) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (128 bits that stand for the set), sig, keys."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    names = ["doc_id", "n_shingles", "h1", "h2", "sig", "keys"]

    def run(batches):
        for batch in slices(batches):
            n, ids, sigs = [], [], np.zeros((batch.num_rows, HASHES), np.uint16)
            for i, text in enumerate(_texts(batch)):
                s = shingles(text, k)
                n.append(len(s))
                ids.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                if len(s):
                    sigs[i] = signature(s)
            found = keys(sigs, n_chunks)
            cols = [batch.column(0), n, [h[0] for h in ids], [h[1] for h in ids], [s.tobytes() for s in sigs], [f if c else [] for f, c in zip(found, n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema("doc_id long, n_shingles long, h1 long, h2 long, sig binary, keys array<long>"))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, k).tobytes() for t in _texts(batch)], pa.binary())], names=["id", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, schema("id long, hashes binary"))


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Similarity is at most the ratio of the sizes."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _near(pairs: DataFrame, sigs: DataFrame, most_apart: int) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most most_apart symbols."""

    def run(batches):
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= most_apart))

    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, schema("a long, b long"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""

    def run(batches):
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                common = int((t[at] == s).sum())
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, schema("a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, most_apart: int | None = None, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    most_apart follows from percent where it isn't given; it must be less than HASHES.
    """
    most_apart = distance(percent) if most_apart is None else most_apart
    if most_apart >= HASHES:
        raise ValueError(f"most_apart must be less than {HASHES}")
    scratch = Scratch(docs.sparkSession, "minhash")
    every = scratch.keep(signatures(docs, k, chunks(most_apart)), "signatures")
    reps = every.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"))
    full = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = scratch.keep(full.select("doc_id").distinct().join(reps.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "copies")
    few = copies.count() <= MOST_SHIPPED
    own = full.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "keys")
    if not few:  # otherwise a second table of signatures and keys isn't needed
        own = scratch.keep(own, "sets")
    exploded = own.select(F.explode("keys").alias("key"), "id", "n")
    sizes = exploded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.keep(exploded.join(sizes, "key"), "members")

    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    large = members.where(F.col("size") > small_bucket)
    hubs = large.join(score, "id").groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"), "n")).alias("hub"))
    a, b = members.where(F.col("size") <= small_bucket).alias("a"), members.where(F.col("size") <= small_bucket).alias("b")
    near_small = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & _may_link(F.col("a.n"), F.col("b.n"), percent)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    near_hub = large.join(hubs, "key").where((F.col("id") != -F.col("hub.id")) & _may_link(F.col("n"), F.col("hub.n"), percent)).select((-F.col("hub.id")).alias("a"), F.col("id").alias("b"))
    sigs = own.select("id", "sig")
    pairs = scratch.keep(_near(near_small.unionByName(near_hub).distinct(), sigs, most_apart), "pairs")
    scratch.drop(own)

    wanted = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(large.select(F.col("id").alias("doc_id"))).distinct(), "wanted")
    sets = scratch.keep(_sets(docs.join(broadcast_if_small(wanted, MOST_SHIPPED), "doc_id", "left_semi").select("doc_id", "text"), k).distinct(), "hashes")
    links = scratch.keep(_links(pairs, sets, percent), "links")
    found = scratch.keep(connected_components(links, scratch), "components")

    more = scratch.keep(_rest(large.select("key", "id", "n"), found, sets, percent, scratch), "rest")
    if not more.isEmpty():
        links = links.unionByName(scratch.keep(_links(more, sets, percent), "links"))
        found = scratch.keep(connected_components(links, scratch), "components")

    scratch.drop_all_but(every, found)

    whole = reps.join(found, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    out = every.select("doc_id", "n_shingles", "h1", "h2").join(whole, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _rest(large: DataFrame, found: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, common: int = COMMON) -> DataFrame:
    """Pairs (a, b) of different components in large buckets (key, id, n) that their shared common or rare shingles allow to be links."""
    placed = large.join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), "key")
    by_component = placed.groupBy("key", "component").agg(F.count("*").alias("many"))
    main = by_component.groupBy("key").agg(F.max(F.struct("many", F.col("component").alias("main"))).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.main").alias("main"))
    open_ = scratch.keep(placed.join(main, "key"), "open")
    docs = scratch.keep(open_.select("id", "n", "component").distinct(), "apart")

    held = docs.join(sets, "id").select("id", "n", "component", F.explode(_longs("hashes")).alias("shingle"))
    held = scratch.keep(held, "held")
    frequent = scratch.keep(held.groupBy("shingle").agg(F.count("*").alias("many")).where(F.col("many") > common).select("shingle"), "common")
    rare = held.join(broadcast_if_small(frequent, MOST_SHIPPED), "shingle", "left_anti")
    rare = rare.groupBy("id", "n", "component").agg(F.sort_array(F.collect_list("shingle")).alias("rare"))
    rare = scratch.keep(rare.withColumn("needed", F.ceil(percent * F.col("n") / 100) - (F.col("n") - F.size("rare"))), "rare")

    prefix = F.slice("rare", F.lit(1), F.greatest(F.size("rare") - F.greatest("needed", F.lit(1)) + 1, F.lit(0)).cast("int"))
    holders = rare.select(F.explode(prefix).alias("shingle"), F.struct("id", "n", "component").alias("doc")).groupBy("shingle").agg(F.collect_list("doc").alias("docs")).where(F.size("docs") > 1)
    each = holders.select("docs", F.explode("docs").alias("x")).select("x", F.explode("docs").alias("y"))
    by_rare = each.where((F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _may_link(F.col("x.n"), F.col("y.n"), percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    counted = docs.join(rare.select("id", "n", F.size("rare").alias("rare")), ["id", "n"], "left").select("id", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common"))
    counted = counted.where(100 * F.col("common") >= percent * F.col("n"))
    rich = scratch.keep(open_.join(counted, ["id", "n"]), "rich")
    a, b = rich.where("component <> main").alias("a"), rich.alias("b")
    most = F.least("a.common", "b.common")
    fits = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & (100 * most >= percent * (F.col("a.n") + F.col("b.n") - most))
    by_common = a.join(b, fits).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    return by_rare.unionByName(by_common).distinct()


def _longs(column: str) -> Column:
    """A binary of 8-byte hashes as an array of hexadecimal strings, one per hash."""
    starts = F.sequence(F.lit(0), (F.length(column) / 8).cast("int") - 1)
    return F.transform(starts, lambda i: F.hex(F.substring(F.col(column), i * 8 + 1, F.lit(8))))


def deduplicate(docs: DataFrame, percent: int = STAGE_PERCENT, k: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest id stays."""
    scratch = Scratch(docs.sparkSession, "deduplicate")
    gone = scratch.keep(near_duplicates(docs.select("doc_id", "text"), percent, k).where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, MOST_SHIPPED), "doc_id", "left_anti").select(*docs.columns)
