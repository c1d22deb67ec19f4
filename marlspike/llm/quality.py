"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled 1; the unlabelled text is all training rows, whose labels aren't looked at.
A linear logistic model over features of the whole text minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

so that the estimated risk on hidden negatives never turns negative by overfitting. The class prior is estimated
first: a classifier of positives against unlabelled text, both weighing alike, has, where only positives lie, the odds
``1 : prior``; the prior follows from its median output on positives it was not fitted on.

The maximum is smoothed within ``SMOOTHED``, so that some twenty Newton steps for both fits reach the minimum; each is
one pass over the features of all training texts, summed up by Spark. Positives are at most ``MOST_POSITIVES`` labelled texts, chosen by a
hash of the id and held on the driver; the bound is a parameter. Scoring reads every whole text.

Rows without a doc_id are unlabelled training texts. Null and empty texts have all features zero and are scored as such. Without positives or unlabelled rows the score is
the prior's default for all. Repeated rows get equal scores. Labels, lang, source and doc_id are never inputs of a
score. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, schema, slices

FOLDS = 5
THRESHOLD = 0.3
MOST_POSITIVES = 8_000
#: Where max(0, risk) bends.
SMOOTHED = 0.01
DEFAULT_PRIOR = 0.5

FEATURES = (
    "has_text", "log_words", "word_length", "upper", "lower", "digit", "space", "comma_stop", "mark", "symbol", "bar",
    "beyond_ascii", "line_feed", "repeated", "distinct", "longest_word", "symbol_2", "upper_2", "repeated_2", "bar_2",
)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b",.;:", b"!?", b"*#$%&@^~=+<>\\/{}[]", b"|", bytes(range(128, 256)), b"\n")):
    _CLASS[list(_chars)] = _k + 1


def features(text: bytes) -> list[float]:
    """Shares of kinds of characters and words; all zero without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    by_class = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=11)[1:] / len(text)
    upper, lower, digit, space, comma, mark, symbol, bar, beyond, feed = by_class.tolist()
    n = len(words)
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n
    distinct = np.log1p(len(set(words))) / np.log1p(n)
    root = (symbol**0.5, upper**0.5, repeated**0.5, bar**0.5)
    return [1.0, np.log1p(n), sum(map(len, words)) / n / 10, upper, lower, digit, space, comma, mark, symbol, bar, beyond, feed, repeated, distinct, np.log1p(max(map(len, words))), *root]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of rows x of unlabelled text, in one vector: number, loss if negative, its gradient and its second derivatives by w."""
    z = x @ w
    s = _sigmoid(z)
    return np.concatenate([[len(x), _softplus(z).sum()], s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])


def newton(objective, size: int) -> np.ndarray:
    """Minimum of objective(w) -> (value, gradient, second derivatives or a positive stand-in), from zero.

    A step that raises the value is cut to a quarter; it ends when steps or what they gain vanish.
    """
    w = np.zeros(size)
    value, gradient, second = objective(w)
    step, share = np.linalg.solve(second, gradient), 1.0
    while share * np.abs(step).max() >= 1e-5:
        after = objective(w - share * step)
        if after[0] > value + 1e-12:
            share /= 4
            continue
        w, gained = w - share * step, value - after[0]
        value, gradient, second = after
        if gained < 1e-9:
            break
        step, share = np.linalg.solve(second, gradient), 1.0
    return w


def estimate_prior(positive: np.ndarray, unlabelled, penalty: float = 1e-3) -> float:
    """Share of positives among the unlabelled rows; ``unlabelled`` gives their :func:`sums` for any weights."""
    half = len(positive) // 2 or len(positive)
    fit, rest = positive[:half], positive[half:] if half < len(positive) else positive
    size = positive.shape[1]

    def objective(w):
        n, loss, slope, second = _parts(unlabelled(w), size)
        z = fit @ w
        s = _sigmoid(z)
        value = (_softplus(-z).mean() + loss / n + penalty * w @ w) / 2
        own = (fit * (s * (1 - s))[:, None]).T @ fit / len(fit)
        return value, (fit.T @ (s - 1) / len(fit) + slope / n) / 2 + penalty * w, (own + second / n) / 2 + penalty * np.eye(size)

    g = float(np.median(_sigmoid(rest @ newton(objective, size))))
    return float(np.clip((1 - g) / max(g, 1e-9), 0.05, 0.95))


def _parts(total: np.ndarray, size: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    return total[0], total[1], total[2 : 2 + size], total[2 + size :].reshape(size, size)


def least_risk(positive: np.ndarray, unlabelled, prior: float, penalty: float) -> np.ndarray:
    """Weights of least non-negative risk. In its second derivatives those parts of either sign cancel, so that they stay positive."""
    size = positive.shape[1]

    def objective(w):
        n, loss, slope, second = _parts(unlabelled(w), size)
        z = positive @ w
        s = _sigmoid(z)
        negative = loss / n - prior * _softplus(z).mean()
        rising = float(_sigmoid(negative / SMOOTHED))
        bend = slope / n - prior * (positive.T @ s) / len(positive)
        own = (positive * (s * (1 - s))[:, None]).T @ positive / len(positive)
        value = prior * _softplus(-z).mean() + SMOOTHED * float(_softplus(negative / SMOOTHED)) + penalty / 2 * w @ w
        gradient = prior * (positive.T @ (s - 1)) / len(positive) + rising * bend + penalty * w
        curved = prior * (1 - rising) * own + rising * second / n + rising * (1 - rising) / SMOOTHED * np.outer(bend, bend)
        return value, gradient, curved + penalty * np.eye(size)

    return newton(objective, size)


class Model:
    """Fitted on positives (an array) and on unlabelled rows, of which it asks for sums only."""

    def __init__(self, positive: np.ndarray, unlabelled: "Unlabelled", penalty: float = 1e-5):
        self.prior, self.weights = DEFAULT_PRIOR, None
        n, total, squares = unlabelled.moments()
        if not len(positive) or not n:
            return
        self.mean = total / n
        self.scale = np.sqrt(np.maximum(squares / n - self.mean**2, 0)) + 1e-6
        p = self._ready(positive)
        given = lambda w: unlabelled.sums(self._ready, w)
        self.prior = estimate_prior(p, given)
        self.weights = least_risk(p, given, self.prior, penalty)

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.weights is None else _sigmoid(self._ready(x) @ self.weights)


class Unlabelled:
    """Features of texts as a table on Spark; every question about them is one pass that returns a short vector."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _summed(self, of, size: int) -> np.ndarray:
        def run(batches):
            total = np.zeros(size)
            for batch in slices(batches, 4000):
                total += of(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total, pa.float64())], names=["place", "value"])

        out = np.zeros(size)
        for r in self.table.mapInArrow(run, schema("place int, value double")).groupBy("place").agg(F.sum("value").alias("value")).collect():
            out[r.place] = r.value
        return out

    def moments(self) -> tuple[float, np.ndarray, np.ndarray]:
        k = len(FEATURES)
        got = self._summed(lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 1 + 2 * k)
        return got[0], got[1 : 1 + k], got[1 + k :]

    def sums(self, ready, w: np.ndarray) -> np.ndarray:
        return self._summed(lambda x: sums(ready(x), w), 2 + len(w) + len(w) ** 2)


def _features(batch, column: str = "text") -> np.ndarray:
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    return np.array([features(t or b"") for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def _measured(rows: DataFrame) -> DataFrame:
    """x: the features of each text."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_features(batch).tolist(), pa.list_(pa.float64()))], names=["x"])

    return rows.select("text").mapInArrow(run, schema("x array<double>"))


def fit(docs: DataFrame, labels: DataFrame, most_positives: int = MOST_POSITIVES) -> Model:
    """Fit on a bounded number of positives of the training rows and on all training rows as unlabelled text."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    trusted = labels.where((F.col("quality") == 1) & ~held_out("doc_id", FOLDS)).select("doc_id").distinct()
    some = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positives)
    got = [r.x for r in _measured(docs.join(F.broadcast(some), "doc_id")).collect()]
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.keep(_measured(docs.where(~held_out("doc_id", FOLDS))), "features")
    model = Model(np.array(got, dtype=float).reshape(len(got), len(FEATURES)), Unlabelled(table))
    scratch.drop(table)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, for every row of docs."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_features(batch)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema("doc_id long, score double"))


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id", FOLDS).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
