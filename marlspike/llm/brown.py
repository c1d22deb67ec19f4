"""Language-model scoring with class-based n-grams: words belong to classes, found by exchange clustering.

    P(word | previous word) = P(class | previous class) * P(word | class)

Class transitions are smoothed over the classes, word emissions over the words of a class and one unknown word. A
text's score is the sum of log10 probabilities of its words and of one end; its perplexity follows from it.

Every word of the training texts gets a class by its own neighbours, and all counts are of all training texts:

1. The ``CARRIED`` most frequent words (found by :func:`heavy`, a bounded count that misses none that is frequent) are
   numbered, and every text is stored as the numbers of its words, so that all that follows reads numbers.
2. To begin with, the ``UNITS`` most frequent of them are exchanged between classes, each to the one where the mutual
   information of neighbouring classes is largest, until a whole sweep moves none: a matrix of fixed size, on the driver.
3. Then all words that occur at least ``LEAST`` times are exchanged, sweep by sweep: their number grows with the corpus. Spark sums up for each word its counts with the classes of all
   its neighbours, words by classes; the table of classes by classes follows from them, and each word moves to the class
   where its counts raise the likelihood most. Every other word moves in a sweep, the rest in the next, so that moves
   don't cancel each other. This ends when fewer than ``FEW_MOVE`` of the words' occurrences move, or when a sweep
   didn't raise the mutual information; the best classes are kept. Only classes and their table pass the driver.
4. Rarer words move once, by their counts with the classes of exchanged neighbours: exchanged themselves, they would fit
   their class to chance, and their neighbours' (on sf0.1 the held-out perplexity was 6,875 with 50 occurrences, 12,059
   when all words were exchanged, 7,587 with the units alone). Those that aren't carried are dealt out by word and sorted;
   a word without such neighbours goes where the class sizes put it. The table of these words stays on Spark.
5. Class transitions are counted over the class sequences of all training texts, rare words included.

Scoring needs each word's count and class, and there are more different words than any task can hold. Those of the
carried words go to every task; rarer ones leave the task as (row, place, word), meet the table in a join and return to
their text's sequence. Words that no training text has belong to the class with the most words.

Null and empty texts are a single end. Repeated rows are scored alike and count as often as they occur. Texts are read
whole, however long; their sequence is a byte a token. Rows without a doc_id are training texts like others. With no training text all counts are zero and scores are still
finite. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, schema, slices

FOLDS = 10
#: At most 254, as a class is a byte.
CLASSES = 64
UNITS = 800
CARRIED = 100_000
#: How often a word must occur to be exchanged; rarer ones would fit their class to chance.
LEAST = 50
#: Share of the exchanged words' occurrences that a sweep must move for another one to follow, and the most sweeps there are.
FEW_MOVE = 0.01
SWEEPS = 12
#: Words whose counts travel together.
BLOCK = 2000
#: Words that a task of heavy() holds; a word that is more than a 200,000th of its tokens is never lost.
TRACKED = 200_000
#: Stands for a text's end among the words; no word holds white space.
END = "\n"
PRIOR = 0.1
HELD_WORDS = 200_000
#: So many words are ordered by Spark; more are cut by graded counts.
TOP = 20_000
HELD_PAIRS = 4_000_000
#: In sequences: a rare word whose class the task doesn't know.
OPEN = 255


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _texts(batch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def heavy(docs: DataFrame, most: int, tracked: int = TRACKED) -> list[bytes]:
    """The most frequent words of the texts, by counts whose common part is taken off whenever a task holds too many words."""

    def run(batches):
        count: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in _texts(batch):
                count.update(words(text))
            if len(count) > 4 * tracked:
                count = cut(count)
        count = cut(count) if len(count) > tracked else count
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    def cut(count: Counter) -> Counter:
        least = int(np.partition(np.fromiter(count.values(), np.int64, len(count)), -tracked - 1)[-tracked - 1])
        return Counter({w: n - least for w, n in count.items() if n > least})

    summed = docs.select("text").mapInArrow(run, schema("word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    if most <= TOP:
        return [r.word.encode() for r in summed.orderBy(F.desc("n"), "word").limit(most).collect()]
    scratch = Scratch(docs.sparkSession, "heavy")
    kept = scratch.keep(summed, "words")  # read twice
    out = [r.word.encode() for r in frequent(kept, most)]
    scratch.drop(kept)
    return out


IDS = "row long, doc_id long, ids binary, rare array<struct<place:int,word:string>>"


def numbered(docs: DataFrame, top: list[bytes]) -> DataFrame:
    """Each text as the numbers of its words among the carried ones, and the other words, -1 there, with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(top)
    kind = pa.list_(pa.struct([("place", pa.int32()), ("word", pa.string())]))

    def run(batches):
        index = {w: i for i, w in enumerate(shared.value)}.get
        for batch in slices(batches):
            numbers, places, rare, starts = [], [], [], [0]
            for text in _texts(batch):
                w = words(text)
                ids = np.fromiter(map(index, w, repeat(-1)), np.int32, len(w))
                missed = np.flatnonzero(ids < 0)
                numbers.append(ids.tobytes())
                places.append(missed)
                rare += [w[i] for i in missed.tolist()]
                starts.append(len(rare))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(places) if places else [], pa.int32()), pa.array(rare, pa.binary()).cast(pa.string())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(numbers, pa.binary()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs, type=kind)], names=["row", "doc_id", "ids", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, schema(IDS))


def _ids(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]


def neighbours(texts: DataFrame, units: int) -> np.ndarray:
    """How often unit j follows unit i: 0 is the end, units come next, the last stands for all other words. A text begins after an end and ends with one."""
    size = units + 2

    def rows(total: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        left = at // size
        cut = np.flatnonzero(np.diff(left, prepend=-1))
        pairs = [np.stack([a, b]).astype(np.int64).tobytes() for a, b in zip(np.split(at % size, cut[1:]), np.split(total, cut[1:]))] if len(at) else []
        return pa.RecordBatch.from_arrays([pa.array(left[cut], pa.int32()), pa.array(pairs, pa.binary())], names=["left", "counts"])

    def run(batches):
        at, total, parts, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(parts), return_counts=True)
            both, back = np.unique(np.concatenate([at, new]), return_inverse=True)
            return both, np.bincount(back, weights=np.concatenate([total, n]), minlength=len(both)).astype(np.int64)

        for batch in slices(batches):
            for ids in _ids(batch):
                u = np.zeros(len(ids) + 2, np.int64)
                u[1:-1] = np.where((ids < 0) | (ids >= units), size - 1, ids + 1)
                parts.append(u[:-1] * size + u[1:])
                held += len(ids) + 1
            if held > HELD_PAIRS:
                at, total = summed()
                parts, held = [], 0
        if parts:
            at, total = summed()
        yield rows(total, at)

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(size, np.int64)
        for counts in group["counts"]:
            to, n = np.frombuffer(counts, np.int64).reshape(2, -1)
            row[to] += n
        return pd.DataFrame({"left": [key[0]], "counts": [row.tobytes()]})

    kind = schema("left int, counts binary")
    out = np.zeros((size, size), np.int64)
    for r in texts.select("ids").mapInArrow(run, kind).groupBy("left").applyInPandas(add, kind).collect():
        out[r.left] = np.frombuffer(r.counts, np.int64)
    return out


def exchange(follows: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each unit. Unit 0, the end, keeps class 0 for itself.

    Units start dealt out by frequency and move, the most frequent first, to the class where the mutual information of
    neighbouring classes is largest, until a sweep moves none.
    """
    n = len(follows)
    follows = follows.astype(float)
    if classes < 2 or n < 2:
        return np.zeros(n, int)
    order = 1 + np.argsort(-(follows.sum(0) + follows.sum(1))[1:], kind="stable")
    of = np.zeros(n, int)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    to, back = follows @ member, follows.T @ member
    table = member.T @ to
    plogp = lambda x: x * np.log(np.maximum(x, 1e-300))
    least = 1e-10 * max(1.0, float(plogp(table.sum())))  # beyond the rounding of sums, so that units never go round in circles
    known = plogp(table)  # of each cell; a move changes two rows and two columns

    def changed(c: int) -> None:
        known[c], known[:, c] = plogp(table[c]), plogp(table[:, c])

    while True:
        moved = 0
        for u in order:
            out, into, self_ = to[u], back[u], follows[u, u]
            if not out.any() and not into.any():
                continue
            c = of[u]
            table[c] -= out
            table[:, c] -= into
            table[c, c] += self_
            changed(c)
            out_, into_ = out.copy(), into.copy()
            out_[c] -= self_
            into_[c] -= self_
            rows, cols, corner = plogp(table + out_), plogp(table + into_[:, None]), np.diag(table)
            kept = np.diag(known)
            gain = rows.sum(1) - known.sum(1) - np.diag(rows) + cols.sum(0) - known.sum(0) - np.diag(cols) + kept + plogp(corner + out_ + into_ + self_)
            left, right = table.sum(1) + into_, table.sum(0) + out_  # whatever the class, the others' totals hold the unit as a neighbour
            gain -= plogp(left + out.sum()) - plogp(left) + plogp(right + into.sum()) - plogp(right)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + least:
                best = c
            table[best] += out_
            table[:, best] += into_
            table[best, best] += self_
            changed(best)
            if best != c:
                moved += 1
                of[u] = best
                column, line = follows[:, u], follows[u]
                to[:, c] -= column
                to[:, best] += column
                back[:, c] -= line
                back[:, best] += line
        if not moved:
            break
    return of


def _counted(follows: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    half = np.zeros((classes, follows.shape[1]))
    np.add.at(half, of, follows)
    out = np.zeros((classes, classes))
    np.add.at(out.T, of, half.T)
    return out


def gains(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an occurrence after class l, and one before class r, adds to the likelihood if the word is in class c: [l, c] and [r, c].

    ``table`` is how often class c follows class l. One row more, of zeros, is for neighbours without a class. Class 0,
    the end's own, is ruled out.
    """
    classes = len(table)
    table = table + PRIOR
    after, before = np.zeros((classes + 1, classes)), np.zeros((classes + 1, classes))
    after[:-1] = np.log(table) - np.log(table.sum(0))
    before[:-1] = np.log(table.T) - np.log(table.sum(1))
    if classes > 1:
        after[:, 0] = -1e9
    return after, before


def information(table: np.ndarray) -> float:
    """The mutual information of neighbouring classes, up to a constant of the corpus."""
    plogp = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return plogp(table) - plogp(table.sum(0)) - plogp(table.sum(1))


def _look(of: np.ndarray, classes: int) -> np.ndarray:
    """Classes by number: the carried words, then the end; words without a class, and number -1, have class ``classes``."""
    return np.concatenate([np.where(of < 0, classes, of), [0, classes]]).astype(np.int64)


def contexts(texts: DataFrame, of: np.ndarray, classes: int) -> DataFrame:
    """block and the counts of its words with the classes before and behind them: cells (word, side, class) and numbers, summed up over all texts."""
    end, side = len(of), classes + 1
    shared = texts.sparkSession.sparkContext.broadcast(_look(of, classes))
    width = BLOCK * 2 * side
    kind = schema("block int, cells binary, n binary")

    def run(batches):
        look, counts, once = shared.value, np.zeros((end + 1) * 2 * side, np.int32), np.int32(1)
        mark = np.int32(end).tobytes()
        for batch in slices(batches):
            texts_ = batch.column("ids").to_pylist()
            if not texts_:
                continue
            line = np.frombuffer(mark + (mark + mark).join(texts_) + mark, np.int32).astype(np.int64)  # each text between two ends
            c = look[line]
            inner = line >= 0
            inner[np.cumsum([0, *(len(x) // 4 + 2 for x in texts_)])[:-1]] = False  # the end before a text is only a neighbour
            at = np.flatnonzero(inner)
            np.add.at(counts, line[at] * 2 * side + c[at - 1], once)
            at = at[line[at] != end]
            np.add.at(counts, (line[at] * 2 + 1) * side + c[at + 1], once)
        cells = np.flatnonzero(counts)
        block, cut = np.unique(cells // width, return_index=True)
        rows = [((x - b * width).astype(np.int32).tobytes(), counts[x].tobytes()) for b, x in zip(block, np.split(cells, cut[1:]))] if len(cells) else []
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "cells", "n"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for cells, n in zip(group["cells"], group["n"]):
            total[np.frombuffer(cells, np.int32)] += np.frombuffer(n, np.int32)
        cells = np.flatnonzero(total)
        return pd.DataFrame({"block": [key[0]], "cells": [cells.astype(np.int32).tobytes()], "n": [total[cells].tobytes()]})

    return texts.select("ids").mapInArrow(run, kind).groupBy("block").applyInPandas(add, kind)


def class_table(counts: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """How often class c follows class l, among words that have one, the end included."""
    side = classes + 1
    shared = counts.sparkSession.sparkContext.broadcast(_look(of, classes))

    def run(batches):
        look, out = shared.value, np.zeros((side, side), np.int64)
        for batch in slices(batches, 8):
            for block, cells, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "n"))):
                cells, n = np.frombuffer(cells, np.int32).astype(np.int64), np.frombuffer(n, np.int64)
                left = cells // side % 2 == 0
                np.add.at(out, (cells[left] % side, look[block * BLOCK + cells[left] // (2 * side)]), n[left])
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out.ravel()[at], pa.int64())], names=["cell", "n"])

    out = np.zeros(side * side)
    for r in counts.mapInArrow(run, schema("cell int, n long")).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(side, side)[:-1, :-1]


def wanted(counts: DataFrame, table: np.ndarray, words_: int) -> tuple[np.ndarray, np.ndarray]:
    """The class where each carried word's counts raise the likelihood most, and how often it occurs; the end comes last."""
    classes = len(table)
    side = classes + 1
    shared = counts.sparkSession.sparkContext.broadcast(gains(table))

    def run(batches):
        after, before = shared.value
        for batch in slices(batches, 4):
            best, many = [], []
            for cells, n in zip(*(batch.column(c).to_pylist() for c in ("cells", "n"))):
                dense = np.zeros(BLOCK * 2 * side)
                dense[np.frombuffer(cells, np.int32)] = np.frombuffer(n, np.int64)
                dense = dense.reshape(BLOCK, 2, side)
                best.append((dense[:, 0] @ after + dense[:, 1] @ before).argmax(axis=1).astype(np.uint8).tobytes())
                many.append(dense[:, 0].sum(axis=1).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(best, pa.binary()), pa.array(many, pa.binary())], names=["block", "best", "many"])

    best, many = np.zeros(words_ + 1 + BLOCK, np.int64), np.zeros(words_ + 1 + BLOCK, np.int64)
    for r in counts.mapInArrow(run, schema("block int, best binary, many binary")).collect():
        span = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
        best[span], many[span] = np.frombuffer(r.best, np.uint8)[: len(best[span])], np.frombuffer(r.many, np.int64)[: len(best[span])]
    return best[: words_ + 1], many[: words_ + 1]


def sweeps(texts: DataFrame, of: np.ndarray, classes: int, scratch: Scratch, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float], np.ndarray]:
    """Exchange of the carried words that occur at least so often, from the classes ``of`` (-1: none yet).

    Gives the classes of all carried words, those of the exchanged ones alone (-1: not exchanged), the counts with the
    end's last, the information after each sweep, and how often class c follows class l among exchanged words.
    """
    seen: list[float] = []
    number = np.arange(len(of))
    best, near, best_table = of, of, np.zeros((classes, classes))
    for sweep in range(SWEEPS + 1):
        counts = scratch.keep(contexts(texts, of, classes), "contexts")
        table = class_table(counts, of, classes)
        to, many = wanted(counts, table, len(of))
        scratch.drop(counts)
        often = (many[:-1] >= least) | (of >= 0)
        whole = (of[often] >= 0).all()
        if whole:
            if seen and information(table) <= seen[-1]:
                break
            seen.append(information(table))
            best, near, best_table = of, to[:-1], table
        moving = often & ((of < 0) | ((to[:-1] != of) & (number % 2 == sweep % 2)))
        if not moving.any() or whole and many[:-1][often & (to[:-1] != of)].sum() < FEW_MOVE * many[:-1][often].sum():
            break
        of = np.where(moving, to[:-1], of)
    return np.where(best < 0, near, best), best, many, seen, best_table


CLASSED = "word string, n long, class int"


def other_words(texts: DataFrame, table: np.ndarray, of: np.ndarray) -> DataFrame:
    """word, n, class of every word of the texts that isn't carried."""
    classes = len(table)
    shared = texts.sparkSession.sparkContext.broadcast((_look(of, classes), *gains(table)))
    end, side = len(of), classes + 1

    def contexts_(batches):
        look, count = shared.value[0], Counter()

        def rows() -> pa.RecordBatch:
            cols = list(zip(*count)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["word", "context", "n"])

        for batch in slices(batches):
            rare = batch.column("rare")
            at, pairs = rare.offsets.to_numpy() - rare.offsets[0].as_py(), rare.flatten()
            names, places = pairs.field("word").to_pylist(), pairs.field("place").to_numpy()
            for i, ids in enumerate(_ids(batch)):
                if at[i] < at[i + 1]:
                    c = look[np.concatenate([[end], ids, [end]])]
                    p = places[at[i] : at[i + 1]]
                    count.update(zip(names[at[i] : at[i + 1]], (c[p] * side + c[p + 2]).tolist()))
            if len(count) > HELD_WORDS:
                yield rows()
                count = Counter()
        yield rows()

    def assign(batches):
        _, after, before = shared.value
        last: tuple[str, int, np.ndarray] | None = None

        def rows(w, n, score) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(np.argmax(score, axis=1), pa.int32())], names=["word", "n", "class"])

        for batch in slices(batches, 20_000):
            if not batch.num_rows:
                continue
            word, context, n = batch.column("word"), batch.column("context").to_numpy(), batch.column("n").to_numpy()
            new = np.ones(len(n), bool)
            new[1:] = pc.not_equal(word.slice(1), word.slice(0, len(n) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            score = np.add.reduceat((after[context // side] + before[context % side]) * n[:, None], first, axis=0)
            many, names = np.add.reduceat(n, first), word.take(pa.array(first))
            if last and last[0] == names[0].as_py():
                score[0] += last[2]
                many[0] += last[1]
            elif last:
                yield rows([last[0]], [last[1]], last[2][None])
            last = (names[len(first) - 1].as_py(), int(many[-1]), score[-1])
            yield rows(names.slice(0, len(first) - 1), many[:-1], score[:-1]) if len(first) > 1 else rows([], [], np.empty((0, classes)))
        if last:
            yield rows([last[0]], [last[1]], last[2][None])

    seen = texts.select("ids", "rare").mapInArrow(contexts_, schema("word string, context int, n long"))
    return seen.repartition("word").sortWithinPartitions("word").mapInArrow(assign, schema(CLASSED))


class Model:
    """Classes and counts of the carried words, the end's last; sizes of classes; transitions, once counted."""

    def __init__(self, of: np.ndarray, n: np.ndarray, size: np.ndarray, kinds: np.ndarray):
        self.of, self.n = np.append(of, 0).astype(np.uint8), n
        self.total, self.distinct = int(size.sum()), int(kinds.sum())
        self.emit = -np.log10(size + PRIOR * (kinds + 1))
        self.unseen = 1 + int(np.argmax(kinds[1:])) if len(kinds) > 1 else 0
        self.base = math.log10(self.total + PRIOR * (self.distinct + 1))
        self.move = np.zeros((len(size), len(size)))

    def learn(self, between: np.ndarray) -> None:
        self.move = np.log10((between + PRIOR) / (between.sum(1, keepdims=True) + PRIOR * len(between)))


def frequent(counts: DataFrame, most: int) -> list:
    """Rows of the most frequent words, the first first: all words above the least of graded counts that no more than ``most`` words reach.

    The grades are counted first, so that no task sends more than its part of these words to the driver.
    """
    grade = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in sorted(counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("many")).collect(), key=lambda r: -r.grade):
        total += r.many
        if total > most:
            break
        least = r.grade
    rows = counts.where(grade >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r.n, r.word))


def fit(texts: DataFrame, carried: int, scratch: Scratch, classes: int = CLASSES, units: int = UNITS, least: int = LEAST) -> tuple[Model, DataFrame]:
    """The model of numbered texts, yet without transitions, and the table of the words that aren't carried."""
    units = min(units, carried)
    start = np.full(carried, -1)
    start[:units] = exchange(neighbours(texts, units)[:-1, :-1], classes)[1:]
    of, exchanged, n, _, between = sweeps(texts, start, classes, scratch, least)
    table = scratch.keep(other_words(texts, between, exchanged), "words")
    size, kinds = np.bincount(of, n[:-1], classes), np.bincount(of[n[:-1] > 0], minlength=classes).astype(float)
    size[0] += n[-1]
    kinds[0] += n[-1] > 0
    for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        size[r["class"]] += r.n
        kinds[r["class"]] += r.kinds
    return Model(of, n, size, kinds), table


PARTS = "row long, doc_id long, n_known long, counted double, sequence binary, rare array<struct<place:int,word:string>>"


def _parts(texts: DataFrame, model: Model) -> DataFrame:
    """Per text: the classes of its words and its end, sums over the carried words, and the words that aren't."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [f.split()[0] for f in PARTS.split(", ")]

    def run(batches):
        m: Model = shared.value
        end, logs = len(m.n) - 1, np.log10(m.n + PRIOR)
        for batch in slices(batches):
            known, counted, sequences = [], [], []
            for ids in _ids(batch):
                at = np.append(ids, end)
                held = at >= 0
                known.append(int((m.n[at[held]] > 0).sum()))
                counted.append(float(logs[at[held]].sum()))
                sequences.append(np.where(held, m.of[at], OPEN).astype(np.uint8).tobytes())
            arrays = [pa.array(known, pa.int64()), pa.array(counted, pa.float64()), pa.array(sequences, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *arrays, batch.column("rare")], names=names)

    return texts.mapInArrow(run, schema(PARTS))


WHOLE = "doc_id long, n_known long, counted double, sequence binary"


def _sequences(parts: DataFrame, table: DataFrame, unseen: int) -> DataFrame:
    """The texts' class sequences without a gap, and their sums over all words."""
    rare = parts.select("row", F.explode("rare").alias("rare")).select("row", "rare.place", "rare.word")
    met = rare.join(table, "word", "left").select("row", (F.col("place").cast("long") * 256 + F.coalesce("class", F.lit(unseen))).alias("code"), F.log10(F.coalesce("n", F.lit(0)) + F.lit(PRIOR)).alias("part"), F.col("n").isNotNull().cast("long").alias("seen"))
    met = met.groupBy("row").agg(F.collect_list("code").alias("codes"), F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    both = parts.drop("rare").join(met, "row", "left").select("doc_id", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), (F.col("counted") + F.coalesce("part", F.lit(0.0))).alias("counted"), "sequence", "codes")

    names = schema(WHOLE).fieldNames()

    def fill(batches):
        for batch in slices(batches):
            out = []
            for sequence, codes in zip(batch.column("sequence").to_pylist(), batch.column("codes")):
                if codes.is_valid:
                    found = codes.values.to_numpy()
                    whole = np.frombuffer(sequence, np.uint8).copy()
                    whole[found >> 8] = found & 255
                    sequence = whole.tobytes()
                out.append(sequence)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_known"), batch.column("counted"), pa.array(out, pa.binary())], names=names)

    return both.mapInArrow(fill, schema(WHOLE))


def transitions(sequences: DataFrame, classes: int) -> np.ndarray:
    """How often class j follows class i; a text begins after an end, which has class 0."""

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for batch in slices(batches):
            for sequence in batch.column("sequence").to_pylist():
                c = np.frombuffer(b"\0" + sequence, np.uint8).astype(np.int64)
                total += np.bincount(c[:-1] * classes + c[1:], minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    out = np.zeros(classes * classes)
    for r in sequences.select("sequence").mapInArrow(run, schema("cell int, n long")).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(classes, classes)


def score(docs: DataFrame, classes: int = CLASSES, units: int = UNITS, carried: int = CARRIED, least: int = LEAST) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the texts whose crc32 of the id is no multiple of FOLDS and scores all. base_score is of single words.
    """
    if not 2 <= classes < OPEN:
        raise ValueError(f"classes must lie between 2 and {OPEN - 1}")
    scratch = Scratch(docs.sparkSession, "brown")
    docs = docs.select("doc_id", "text")
    train = lambda df: df.where(~held_out("doc_id", FOLDS))
    top = heavy(train(docs), carried)
    texts = scratch.keep(numbered(docs, top), "numbered")
    model, table = fit(train(texts), len(top), scratch, classes, units, least)
    whole = scratch.keep(_sequences(_parts(texts, model), table, model.unseen), "sequences")
    scratch.drop(texts)
    model.learn(transitions(train(whole), classes))
    move, emit = model.move, model.emit

    def run(batches):
        for batch in slices(batches):
            n, in_class = [], []
            for sequence in batch.column("sequence").to_pylist():
                c = np.frombuffer(b"\0" + sequence, np.uint8)
                n.append(len(sequence))
                in_class.append(float(move[c[:-1], c[1:]].sum() + emit[c[1:]].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_known"), batch.column("counted"), pa.array(n, pa.int64()), pa.array(in_class, pa.float64())], names=["doc_id", "n_known", "counted", "n_tokens", "in_class"])

    value = F.col("in_class") + F.col("counted")
    return whole.mapInArrow(run, schema("doc_id long, n_known long, counted double, n_tokens long, in_class double")).select(
        "doc_id", held_out("doc_id", FOLDS).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * F.lit(model.base)).alias("base_score"),
        value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )
