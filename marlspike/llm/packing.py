"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokenising is a map over the documents. What is packed afterwards are pieces of a few numbers each, dealt to
packers of bounded size by a hash of the piece and its row, so that neither texts nor token ids are shuffled, and rows
that share an id, or have none, don't share a packer.

A packer is a bounded-space online best-fit: a fixed number of open bins, kept in a bitset whose bit ``f`` says that
a bin with ``f`` free places is open. A piece goes to the bin with the least room that still takes it; when no bin
does, a new one opens, and beyond the fixed number of open bins the fullest closes. Pieces arrive in batches of a
bounded look-ahead, the longest of a batch first. The bound on open bins costs little: see the test of waste.

Null and empty texts are documents of one token, the end id. Repeated rows are packed as often as they occur.
Texts of any length are tokenised whole. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_by_worker, schema, slices

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 256
LOOK_AHEAD = 1024
PIECES_A_PACKER = 32_768
CACHED_CHUNKS = 150_000
#: White space beside the plain space and the line feed.
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = PIECES + ", sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    The byte-level pattern never lets a token run over the place between a visible character and a single space
    before another visible character. Texts are cut there, and the ids of each cut are kept in a bounded cache.
    Texts with other runs of white space, or with a special token's string, are encoded in one go.
    """

    def __init__(self, path: str, end_id: int):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids don't follow the order of its merges")
        self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = array("I", [end_id]).tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.ranks.encode_ordinary(text)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and a chunk without spaces: from the older half of the cache, or encoded; kept in the younger."""
        ids = self.old.get(chunk)
        if ids is None:
            word = chunk.rstrip(".,")
            if word and word is not chunk and word.isalpha():
                tail = chunk[len(word) :]
                ids = (self.young.get(word) or self._chunk(word)) + (self.tails.get(tail) or self.tails.setdefault(tail, self._ids(tail)))
            elif word.isalpha():
                ids = array("I", self.ranks._core_bpe.encode_single_piece(f" {word}".encode())).tobytes()
            else:
                ids = self._ids(f" {chunk}")
        if len(self.young) > CACHED_CHUNKS:
            self.old, self.young, self.tails = self.young, {}, {}
        self.young[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return self.end
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        if "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, OTHER_SPACE)):
            return self._ids(text) + self.end
        first, *rest = text.split(" ")
        known = self.young.get
        found = [known(c) or self._chunk(c) for c in rest]
        return self._ids(first) + b"".join(found) + self.end


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the byte-level vocabulary: visible Latin-1 characters are themselves, the others follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _encoder(path: str, end_id: int) -> Encoder:
    return held_by_worker(("packing", path, end_id), lambda: Encoder(path, end_id))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole capacities from its end, the rest in front."""
    head = n % capacity if n > capacity else n
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (head if head and s == 0 else capacity)) for s in starts]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents, without their ids: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encode = _encoder(vocabulary, end_id)
        for batch in slices(batches):
            rows: list[tuple[int, ...]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "")
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema(PIECES))


class BestFit:
    """A bounded number of open bins; place() gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = self.bins = self.closed = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        got = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return got

    def place(self, need: int) -> tuple[int, int]:
        fits = self.bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            got = self._take(free)
        else:
            free, got = self.capacity, self.bins
            self.bins += 1
        left = free - need
        if left:
            self.by_free[left].append(got)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
        return got, self.capacity - free


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in batches of look_ahead, the longest of each batch first."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    packer = BestFit(capacity, open_bins)
    for at in range(0, len(lengths), look_ahead):
        for i in at + np.argsort(-lengths[at : at + look_ahead], kind="stable"):
            bins[i], offsets[i] = packer.place(int(lengths[i]))
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD, a_packer: int = PIECES_A_PACKER) -> DataFrame:
    """Give each piece a sequence and its offset there; n_pieces says how many packers of about a_packer pieces work."""
    packers = max(1, -(-n_pieces // a_packer))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id", "piece"], kind="stable")
        bins, offsets = pack_lengths(group["length"].to_numpy(), capacity, open_bins, look_ahead)
        return group.assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)[[c.split()[0] for c in PLACES.split(", ")]]

    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())  # pieces are a stored table, so a row's number stays
    dealt = pieces.withColumn("order", order).withColumn("packer", F.pmod(F.xxhash64("order"), F.lit(packers)).cast("int"))
    return dealt.groupBy("packer").applyInPandas(run, schema(PLACES))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return pack(pieces, pieces.count(), capacity)
