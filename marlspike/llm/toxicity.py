"""Toxicity: noisy-channel restoration of obfuscated words, then a score of the restored text.

A writer meant a word and typed something else: digits and signs for letters, signs or spaces between letters,
letters again and again. Each odd token becomes a lattice of the letters that each character may stand for, with the
channel's cost of each; the Viterbi path under a character trigram model is the restored word. A token of letters
without runs has a single path through its lattice, itself, and is not decoded. Single letters, or what may stand for
them, in a row, apart by spaces or signs, are joined first. A sign within a token, or a space within such a row, may
also end a word: a second path, with such ends, cuts the token into words. Tokens of any length are decoded.

What is toxic is learned from labelled training rows: for each restored word and its beginnings of 4 to 6 letters,
how many toxic and other texts hold it. A text's score is a logistic function of its strongest words' weights. That
function is fitted with each text's own counts taken out of the weights it sees.

Fitting uses every labelled training row and all of its whole text: trigrams and words are counted, and the function is
fitted by sums over a stored table of the rows' inputs. Trigrams and telling words go to the driver, sums of a few
numbers besides; no text and no row of inputs does. Scoring reads every whole text, and all of a text's words count.

Rows without a doc_id have no label and are scored like others. Null and empty texts have no words and get the function's value at zero. Without labelled rows every score is 0.
Repeated rows get equal scores. Labels, lang, source and doc_id are never inputs of a score. Extra columns don't
matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_by_worker, held_out, schema, slices

FOLDS = 5
THRESHOLD = 0.5
#: More labelled rows than that are joined by a shuffle, and their texts stored once.
MOST_BROADCAST = 2_000_000
CACHED = 100_000
#: Words that a task counts before it hands them on.
COUNTED = 300_000
#: Words whose trigrams are looked at together, as each takes about 700 bytes meanwhile.
TOGETHER = 30_000

#: What a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "¡": "i",
}
#: Signs that may stand between letters and mean nothing.
BETWEEN = frozenset(".-_*~'`^,:;/\\#%&=\"")
SUBSTITUTE, OMIT, AGAIN, UNKNOWN = 1.5, 0.4, 0.2, 9.0
#: Longer tokens are decoded each time they occur.
LONGEST_CACHED = 64

_LETTER = rf"(?:[^\W_]|[{re.escape(''.join(c for c in STANDS_FOR if not c.isalnum()))}])"
_SPACED = re.compile(rf"(?<![^\W_]){_LETTER}(?:[ .\-_*]{{1,2}}{_LETTER}){{3,}}(?![^\W_])")
_INNER = re.compile(r"[^\W_][\W_]+[^\W_]")
_RUN = re.compile(r"(.)\1\1", re.DOTALL)
_EDGES = ".,;:!?\"'()[]{}<>*#%&~-_"


class CharacterModel:
    """Trigrams of letters within words, interpolated with bigrams and single letters; \\x02 begins, \\x03 ends."""

    def __init__(self, trigrams: dict[str, int]):
        self.three, self.two, self.one = dict(trigrams), Counter(), Counter()
        self.two_from, self.one_from = Counter(), Counter()
        for t, n in trigrams.items():
            self.two_from[t[:2]] += n
            self.two[t[1:]] += n
            self.one_from[t[1]] += n
            self.one[t[2]] += n
        self.total = sum(self.one.values()) or 1
        self.known: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """-log P(c after ab)."""
        key = a + b + c
        got = self.known.get(key)
        if got is None:
            three = self.three.get(key, 0) / (self.two_from[a + b] or 1)
            two = self.two[b + c] / (self.one_from[b] or 1)
            p = 0.7 * three + 0.2 * two + 0.09 * self.one[c] / self.total + 1e-6
            got = self.known[key] = -math.log(p)
        return got


def lattice(token: str, breaks: bool = False) -> list[list[tuple[str, float]]]:
    """For each character, or run of one, what it may stand for and at what cost; with breaks, signs and spaces may end a word."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c, run = token[at], 1
        while at + run < len(token) and token[at + run] == c:
            run += 1
        at += run
        if c.isalpha():
            options = [(c * run, 0.0)] if run < 3 else [(c, AGAIN), (c + c, AGAIN)]
        else:
            options = [(s * k, SUBSTITUTE * k) for s in STANDS_FOR.get(c, "") for k in ({1, run} if run < 3 else {1})]
            if c in BETWEEN or c in STANDS_FOR:
                options.append(("", OMIT * run))
            if not options:
                options = [(c * run, UNKNOWN * run)]
            if c == " ":
                options = [("", 0.0)]
            if breaks and not c.isalnum():
                options.append((" ", 0.0 if c == " " else OMIT * run))
        out.append(options)
    return out


def restore(token: str, model: CharacterModel, breaks: bool = False) -> str:
    """The cheapest path: states are the last two letters. With breaks, its words are apart by spaces."""
    start = ("\x02", "\x02")
    best: dict[tuple[str, str], tuple[float, tuple]] = {start: (0.0, ())}
    for options in lattice(token, breaks):
        step: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in best.items():
            for letters, channel in options:
                x, y, total = a, b, cost + channel
                for c in letters:
                    if c != " ":
                        total += model.cost(x, y, c)
                        x, y = y, c
                    elif (x, y) != start:
                        total += model.cost(x, y, "\x03")
                        x, y = start
                if (x, y) not in step or total < step[x, y][0]:
                    step[x, y] = (total, (path, letters) if letters else path)
        best = step
    ends = [(cost + (model.cost(a, b, "\x03") if not breaks or (a, b) != start else 0.0), path) for (a, b), (cost, path) in best.items()]
    path, out = min(ends, key=lambda e: e[0])[1], []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def is_odd(token: str) -> bool:
    """Whether the lattice of a token with letters has more than one path."""
    return not token.isalpha() or _RUN.search(token) is not None


def tokens(text: str) -> list[str]:
    """Lower-cased tokens; single letters in a row are one, and another with spaces, as it may be several words."""
    text = text.lower()
    spaced = [re.sub(r"[ .\-_*]+", " ", m[0]) for m in _SPACED.finditer(text)]
    return text.split() + [s.replace(" ", "") for s in spaced] + spaced


def parts(word: str) -> list[str]:
    return [word] + [word[:k] + "~" for k in (4, 5, 6) if len(word) > k]


class Reader:
    """Restored words of texts, with a bounded memory of decoded tokens."""

    def __init__(self, model: CharacterModel | None):
        self.model = model
        self.seen: dict[str, list[str]] = {}

    def whole(self, token: str) -> list[str]:
        """The restored words of a token."""
        word = token.strip(_EDGES)
        if not is_odd(word):
            return [word]
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) > CACHED // 4:
                self.seen.clear()
            got = [word] if word.isalpha() else []
            if self.model and any(map(str.isalpha, token)):
                got += [restore(form, self.model) for form in ({word, token} if " " not in token else ())]
                if _INNER.search(word) or " " in token:
                    got += restore(token, self.model, breaks=True).split()
            if len(token) <= LONGEST_CACHED:
                self.seen[token] = got
        return got

    def __call__(self, token: str) -> list[str]:
        return [p for w in self.whole(token) for p in parts(w)]

    def words(self, text: str) -> list[list[str]]:
        """For each distinct token its restored words and their beginnings."""
        return [got for got in map(self, set(tokens(text))) if got]

    def held(self, text: str) -> set[str]:
        """All restored words of a text and their beginnings."""
        found = {w for token in set(tokens(text)) for w in self.whole(token)}
        return found.union(*({w[:k] + "~" for w in found if len(w) > k} for k in (4, 5, 6)))


class Model:
    """Counts of texts by word, and the logistic function of a text's strongest weight and of the sum and number of its strong ones."""

    def __init__(self, characters: CharacterModel, counts: dict[str, tuple[int, int]], toxic: int, other: int):
        self.characters, self.counts, self.toxic, self.other = characters, counts, toxic, other
        self.coefficients = np.zeros(4)
        self.fitted = False

    def weight(self, toxic: int, other: int, own: int | None = None) -> float:
        """Log odds against the base rate, shrunk; without the own text's part if ``own`` is its label."""
        toxic, other = toxic - (own == 1), other - (own == 0)
        rate = (self.toxic + 1) / (self.toxic + self.other + 2)
        return math.log((toxic + 4 * rate) / (other + 4 * (1 - rate)) * (1 - rate) / rate)

    def token_weight(self, words: list[str], own: int | None = None) -> float:
        """The largest weight of a token's words."""
        return max([0.0, *(self.weight(*self.counts[w], own) for w in words if w in self.counts)])

    @staticmethod
    def inputs(weights: list[float]) -> list[float]:
        """From the weights of a text's tokens."""
        strong = [w for w in weights if w > 1.0]
        return [1.0, max(weights, default=0.0), math.log1p(sum(strong)), math.log1p(len(strong))]

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> None:
        """Fits to the inputs and labels of texts, if there are both labels."""
        if len(y) and y.min() != y.max():
            self.fit_by(lambda w: _sums(x, y, w), penalty)

    def fit_by(self, sums, penalty: float = 1.0) -> None:
        """Ridge logistic regression by Newton steps that are halved until they help, so that separable texts don't run away.

        ``sums`` gives loss, gradient and second derivatives over all texts for any coefficients.
        """
        ridge = penalty * np.array([1e-3, 1, 1, 1])

        def objective(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            loss, slope, second = np.split(sums(w), [1, 5])
            return float(loss[0] + (ridge * w * w).sum() / 2), slope + ridge * w, second.reshape(4, 4) + np.diag(ridge)

        w = np.zeros(4)
        now, slope, second = objective(w)
        for _ in range(100):
            step, share = np.linalg.solve(second, slope), 1.0
            after = objective(w - step)
            while share > 1e-6 and after[0] > now:
                share /= 2
                after = objective(w - share * step)
            gained = now - after[0]
            w, (now, slope, second) = w - share * step, after
            if gained < 1e-9 * max(1.0, now):
                break
        self.coefficients, self.fitted = w, True

    def score(self, weights: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.coefficients, self.inputs(weights))))))) if self.fitted else 0.0


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, its gradient and its second derivatives, in one vector."""
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    return np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _trigrams(count: Counter[str]) -> Iterator[pa.RecordBatch]:
    """Trigrams of words with their numbers, each word as often as counted, of a part of the words after the other."""
    words = [w for w in count if w.isalpha()]
    for at in range(0, len(words), TOGETHER):
        yield _trigrams_of(words[at : at + TOGETHER], count)


def _trigrams_of(words: list[str], count: Counter[str]) -> pa.RecordBatch:
    codes = np.frombuffer("".join(f"\x02\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    times = np.repeat(np.array([count[w] for w in words], np.int64), [len(w) + 3 for w in words])
    within = np.flatnonzero((codes[:-2] != 3) & (codes[1:-1] != 3))
    keys, places = np.unique(codes[within] << 42 | codes[within + 1] << 21 | codes[within + 2], return_inverse=True)
    total = np.bincount(places, times[within], len(keys)).astype(np.int64)
    grams = ["".join(map(chr, (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))) for k in keys.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(total)], names=["word", "n"])


def _labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """text and toxic of all labelled training rows."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id", FOLDS)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = scratch.keep(known, "labels")
    texts = docs.select("doc_id", "text")
    if known.count() <= MOST_BROADCAST:
        return texts.join(F.broadcast(known), "doc_id").select("text", "toxic")
    return scratch.keep(texts.join(known.hint("merge"), "doc_id").select("text", "toxic"), "texts")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled training rows: letters, then words, then the function."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = _labelled(docs, labels, scratch)

    def letters(batches):
        count: Counter[str] = Counter()
        for batch in slices(batches):
            for text in _texts(batch):
                count.update({w.strip(_EDGES) for w in set(text.lower().split())})
            if len(count) > COUNTED:
                yield from _trigrams(count)
                count.clear()
        yield from _trigrams(count)

    grams = rows.mapInArrow(letters, schema("word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    characters = CharacterModel({r.word: r.n for r in grams.collect()})
    shared = spark.sparkContext.broadcast(characters)

    def counted(batches):
        read, counts = Reader(shared.value), (Counter(), Counter())
        for batch in slices(batches):
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
                counts[toxic].update(read.held(text))
            if sum(map(len, counts)) > COUNTED:
                yield from passed_on(counts)
        yield from passed_on(counts)

    def passed_on(counts):
        for toxic, count in enumerate(counts):
            none = pa.array(np.zeros(len(count), np.int64))
            number = pa.array(list(count.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), number if toxic else none, none if toxic else number], names=["word", "toxic", "other"])
            count.clear()

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    model = Model(characters, {}, toxic, other)
    words = rows.mapInArrow(counted, schema("word string, toxic long, other long")).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    telling = words.where((F.col("toxic") >= 2) & (F.col("toxic") * (other + 1) > 2 * F.col("other") * (toxic + 1)))
    model.counts = {r.word: (r.toxic, r.other) for r in telling.collect()}
    if toxic and other:
        table = scratch.keep(_inputs(rows, model), "inputs")
        model.fit_by(lambda w: _summed(table, w))
    scratch.close()
    return model


def _inputs(rows: DataFrame, model: Model) -> DataFrame:
    """x: each text's inputs, with its own counts taken out of the weights, and its label."""
    import uuid

    shared, key = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        scorers = held_by_worker(key, lambda: [_Scorer(shared.value, own) for own in (0, 1)])
        for batch in slices(batches):
            got = [[*Model.inputs(scorers[toxic].weights(text)), float(toxic)] for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64()))], names=["x"])

    return rows.mapInArrow(run, schema("x array<double>"))


def _summed(table: DataFrame, w: np.ndarray) -> np.ndarray:
    def run(batches):
        total = np.zeros(21)
        for batch in slices(batches, 4000):
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, 5)
            total += _sums(x[:, :4], x[:, 4], w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(21), pa.int32()), pa.array(total)], names=["place", "value"])

    out = np.zeros(21)
    for r in table.mapInArrow(run, schema("place int, value double")).groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out


class _Scorer:
    """A worker's reader with a bounded memory of tokens' weights; without the part of a text's own label, if ``own`` is it."""

    def __init__(self, model: Model, own: int | None = None):
        self.model, self.read = model, Reader(model.characters)
        self.weight = {word: weight for word, count in model.counts.items() if (weight := model.weight(*count, own)) > 0}
        self.known: dict[str, float] = {}

    def token_weight(self, token: str) -> float:
        get, best = self.weight.get, 0.0
        for word in self.read.whole(token):
            best = max(best, get(word, 0.0))
            for k in (4, 5, 6):
                if len(word) > k:
                    best = max(best, get(word[:k] + "~", 0.0))
        return best

    def weights(self, text: str) -> list[float]:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        out = []
        for token in set(tokens(text)):
            got = known.get(token)
            if got is None:
                got = known[token] = self.token_weight(token)
            if got:
                out.append(got)
        return out

    def __call__(self, text: str) -> float:
        return self.model.score(self.weights(text))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, for every row of docs."""
    import uuid

    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        scorer = held_by_worker(key, lambda: _Scorer(shared.value))
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scorer(t) for t in _texts(batch)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema("doc_id long, score double"))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns; scored in one pass, without a join."""
    import uuid

    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches):
        scorer = held_by_worker(key, lambda: _Scorer(shared.value))
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
