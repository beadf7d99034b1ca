"""Linear models on presence features: choice of features in Spark, fits on a bounded sample."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import batches, fewest

Extract = Callable[..., set[str]]


def bounded(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Documents of at most `rows` rows of `labels` (doc_id, ...), with the labels' columns.

    The rows are taken in the order of a hash of doc_id, so the same tables give the same sample. Their ids, as many as
    `rows` says, are sent to where the texts are.
    """
    some = fewest(labels.where("doc_id IS NOT NULL"), rows, F.col("doc_id"), *labels.columns)
    kept = [c for c in documents.columns if c == "doc_id" or c not in labels.columns]
    return documents.select(*kept).join(F.broadcast(some), "doc_id")


def feature_counts(sample: DataFrame, columns: Sequence[str], extract: Extract, classes: Sequence[str]) -> DataFrame:
    """feature, n and n_<class>: in how many rows of `sample` it is, and in how many with that class 1."""

    def count(batch: pa.RecordBatch) -> pa.Table:
        seen: dict[str, list[int]] = defaultdict(lambda: [0] * (1 + len(classes)))
        values = [batch.column(name).to_pylist() for name in columns]
        marks = list(zip(*(batch.column(name).to_pylist() for name in classes)))
        for row, mark in zip(zip(*values), marks):
            for feature in extract(*row):
                counts = seen[feature]
                counts[0] += 1
                for k, one in enumerate(mark):
                    counts[k + 1] += one == 1
        names = ["n", *(f"n_{c}" for c in classes)]
        arrays = {name: pa.array([v[k] for v in seen.values()], pa.int64()) for k, name in enumerate(names)}
        return pa.table({"feature": pa.array(list(seen), pa.string()), **arrays})

    names = ["n", *(f"n_{c}" for c in classes)]
    parts = batches(sample.select(*columns, *classes), count, "feature string, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("feature").agg(*(F.sum(n).alias(n) for n in names)).where("n >= 3")


def telling(counts: DataFrame, name: str, total: int, positive: int, most: int, least: float = 15.0) -> list[str]:
    """At most `most` features whose chi-square against the class is `least` or more, the largest first."""
    if not 0 < positive < total:
        return []
    n, a = F.col("n").cast("double"), F.col(f"n_{name}").cast("double")
    expected = n * positive / total
    spread = expected * (1 - positive / total) * (1 - n / total)
    chi = F.when(spread > 0, (a - expected) ** 2 / spread)
    rows = counts.select("feature", chi.alias("chi")).where(F.col("chi") >= least).orderBy(F.desc("chi"), "feature").limit(most)
    return [r["feature"] for r in rows.collect()]


class Rows:
    """Which of the chosen features each row has."""

    def __init__(self, lists: Sequence[Sequence[int]]) -> None:
        self.size = len(lists)
        self.row = np.repeat(np.arange(self.size), [len(x) for x in lists])
        self.column = np.fromiter((i for x in lists for i in x), np.int64, len(self.row))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.size)

    def gathered(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, values[self.row], width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Logistic:
    """Logistic regression on presence features and dense columns, fitted by L-BFGS."""

    def __init__(self, width: int, dense: int) -> None:
        self.width, self.weights = width, np.zeros(width + dense + 1)

    def score(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        w = self.weights
        return rows.times(w[: self.width]) + dense @ w[self.width : -1] + w[-1]

    def fit(self, rows: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, ridge: float = 1.0, steps: int = 100) -> Logistic:
        """use: weight of each row, 0 to leave it out."""
        n = max(float(use.sum()), 1.0)

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            self.weights = w
            z = self.score(rows, dense)
            off = use * (sigmoid(z) - y)
            grad = np.concatenate([rows.gathered(off, self.width), off @ dense, [off.sum()]]) / n
            penalty = ridge / n * w
            penalty[-1] = 0
            return float((use * (np.logaddexp(0, z) - y * z)).sum()) / n + 0.5 * float(penalty @ w), grad + penalty

        w = self.weights
        value, grad = loss(w)
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(steps):
            step, stack = grad.copy(), []
            for s, d in reversed(past):
                a = (s @ step) / (s @ d)
                stack.append(a)
                step -= a * d
            if past:
                s, d = past[-1]
                step *= (s @ d) / (d @ d)
            for (s, d), a in zip(past, reversed(stack)):
                step += (a - (d @ step) / (s @ d)) * s
            length = 1.0
            for _ in range(30):
                new = w - length * step
                new_value, new_grad = loss(new)
                if new_value <= value - 1e-4 * length * (grad @ step):
                    break
                length /= 2
            else:
                break
            if (new - w) @ (new_grad - grad) > 1e-12:
                past = [*past[-9:], (new - w, new_grad - grad)]
            done = value - new_value < 1e-7
            w, value, grad = new, new_value, new_grad
            if done:
                break
        self.weights = w
        return self


def folds(ids: np.ndarray, number: int) -> np.ndarray:
    """Fold of each row; rows of one id share it."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(number)).astype(np.int64)


def cut(scores: np.ndarray, positive: np.ndarray, cost: float, default: float) -> float:
    """The score from which on flagging gains most: flagged positive rows less `cost` times flagged negative ones.

    Half-way to the next lower score; `default` if no score gains.
    """
    if not positive.any():
        return default
    order = np.argsort(-scores, kind="stable")
    gain = np.cumsum(np.where(positive[order], 1.0, -cost))
    ranked = scores[order]
    gain[:-1][ranked[1:] == ranked[:-1]] = -np.inf
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return default
    return float(ranked[best] if best + 1 == len(ranked) else (ranked[best] + ranked[best + 1]) / 2)


class Dictionary:
    """Chosen features by name, with the numbers that a word's features give."""

    def __init__(self, names: Sequence[str], of_word: Callable[[str], Sequence[str]]) -> None:
        self.numbers = {name: i for i, name in enumerate(names)}
        self.of_word, self.known = of_word, {}

    def __len__(self) -> int:
        return len(self.numbers)

    def of(self, words: set[str]) -> set[int]:
        known, out = self.known, set()
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = tuple(self.numbers[f] for f in self.of_word(word) if f in self.numbers)
                if len(known) > 500_000:  # a memo, not a result
                    known.clear()
                known[word] = ids
            if ids:
                out.update(ids)
        return out
