"""Quality classifier by co-training.

One classifier sees the content of a text, the other what is known about the page. Over some rounds each labels the
unlabelled rows of which it is sure for the other one. At the end both are calibrated on rows they were not trained on,
and a small model of the two calibrated scores judges every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import linear
from riskloom.llm.common import batches, stored

SIGNS = re.compile(r"[^\w\s]+")
METADATA = ("lang", "source", "n_chars")


@dataclass(frozen=True)
class CoTrainingSetting:
    """labelled, unlabelled: bounds of the samples; features: most features of one view; least: chi-square that a
    content feature must have; rounds: of exchange;
    sure: least probability of a pseudo-label; share: most pseudo-labels of a class in one round, of its labelled rows;
    cost: how many rejected bad rows a rejected good one outweighs.
    """

    labelled: int = 6000
    unlabelled: int = 4000
    features: int = 3000
    least: float = 15.0
    rounds: int = 3
    sure: float = 0.97
    share: float = 0.2
    folds: int = 3
    ridge: float = 1.0
    cost: float = 10.0


def bucket(name: str, value: float) -> str:
    """A feature for the size of a rate: equal ones for rates within about a quarter of each other."""
    return f"{name}:{int(np.floor(3 * np.log2(value)))}" if value > 0 else f"{name}:none"


def content(text: str | None) -> tuple[set[str], set[str]]:
    """Words of a text, and features of its shape: runs of signs, and rates that tell prose from other things."""
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    signs = Counter(SIGNS.findall(text))
    lines = [line for line in text.split("\n") if line.strip()]
    shape = {f"sign:{s[:4]}" for s, k in signs.items() if k >= 3}
    shape.add(bucket("signs", sum(k for s, k in signs.items() if s not in ".,;:'\"-") / n))
    shape.add(bucket("capitals", sum(map(str.isupper, words)) / n))
    shape.add(bucket("digits", sum(map(str.isdigit, words)) / n))
    shape.add(bucket("single", sum(len(w) == 1 for w in words) / n))
    shape.add(bucket("distinct", len(set(words)) / n))
    shape.add(bucket("again", 1 - len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1)))
    shape.add(bucket("lines", 1 - len(set(lines)) / max(len(lines), 1)))
    shape.add(bucket("length", sum(map(len, words)) / n))
    shape.add(bucket("words", len(words)))
    return set(words), shape


def word_feature(word: str) -> tuple[str]:
    return (f"={word}",)


def itself(name: str) -> tuple[str]:
    return (name,)


def content_features(text: str | None) -> set[str]:
    words, shape = content(text)
    return {f"={w}" for w in words} | shape


def metadata_features(*values) -> set[str]:
    """Each value, sizes by bucket, and each pair of the values that are no sizes."""
    names = [f"{i}={v}" for i, v in enumerate(values) if not isinstance(v, (int, float))]
    sizes = [bucket(str(i), v) for i, v in enumerate(values) if isinstance(v, (int, float))]
    pairs = [f"{a}&{b}" for k, a in enumerate(names) for b in names[k + 1 :]]
    return {*names, *sizes, *pairs}


class Model:
    """Both views' classifiers, their calibration and the limit below which a document is rejected."""

    def __init__(self, content_names: Sequence[str], metadata_names: Sequence[str]) -> None:
        self.content = linear.Dictionary(content_names, word_feature)
        self.metadata = linear.Dictionary(metadata_names, itself)
        self.views = [linear.Logistic(len(self.content), 0), linear.Logistic(len(self.metadata), 0)]
        self.calibration = [(1.0, 0.0), (1.0, 0.0)]
        self.joint, self.limit = linear.Logistic(0, 2), 0.0

    def numbers(self, text: str | None, values: Sequence) -> tuple[list[int], list[int]]:
        words, shape = content(text)
        ids = self.content.of(words)
        ids.update(self.content.numbers[s] for s in shape if s in self.content.numbers)
        return sorted(ids), sorted(self.metadata.of(metadata_features(*values)))

    def probability(self, rows: Sequence[linear.Rows]) -> np.ndarray:
        scores = [view.score(r, np.zeros((r.size, 0))) for view, r in zip(self.views, rows)]
        both = np.column_stack([a * s + b for s, (a, b) in zip(scores, self.calibration)])
        return linear.sigmoid(self.joint.score(linear.Rows([()] * len(both)), both))

    def fit(self, ids: np.ndarray, rows: Sequence[linear.Rows], y: np.ndarray, setting: CoTrainingSetting) -> Model:
        """y: 1 for good, 0 for bad, NaN for rows without a label."""
        known, none = ~np.isnan(y), np.zeros((len(y), 0))
        truth = np.where(known, y, 0.0)
        if not known.any():
            return self
        given = [y.copy(), y.copy()]  # what each view is trained on
        quota = {c: max(1, int(setting.share * (truth[known] == c).sum())) for c in (0.0, 1.0)}

        def fitted(k: int, use: np.ndarray) -> linear.Logistic:
            width = self.views[k].width
            return linear.Logistic(width, 0).fit(rows[k], none, np.nan_to_num(given[k]), use, setting.ridge)

        for _ in range(setting.rounds):
            p = [linear.sigmoid(fitted(k, ~np.isnan(given[k]) * 1.0).score(rows[k], none)) for k in (0, 1)]
            for k in (0, 1):
                other = given[1 - k]
                for c, sure in ((1.0, p[k]), (0.0, 1 - p[k])):
                    free = np.flatnonzero(np.isnan(other) & (sure >= setting.sure))
                    best = free[np.argsort(-sure[free], kind="stable")][: quota[c]]
                    other[best] = c
        fold = linear.folds(ids, setting.folds)
        held = np.zeros((len(y), 2))
        for k in (0, 1):
            for f in range(setting.folds):
                use = ~np.isnan(given[k]) & (fold != f)
                held[fold == f, k] = fitted(k, use * 1.0).score(rows[k], none)[fold == f]
            self.views[k] = fitted(k, ~np.isnan(given[k]) * 1.0)
            platt = linear.Logistic(0, 1).fit(linear.Rows([()] * len(y)), held[:, k : k + 1], truth, known * 1.0, 1e-3)
            self.calibration[k] = (float(platt.weights[0]), float(platt.weights[1]))
        both = np.column_stack([a * held[:, k] + b for k, (a, b) in enumerate(self.calibration)])
        empty = linear.Rows([()] * len(y))
        self.joint.fit(empty, both, truth, known * 1.0, 1e-3)
        p = linear.sigmoid(self.joint.score(empty, both))[known]
        self.limit = 1 - linear.cut(1 - p, truth[known] == 0, setting.cost, 1.0)
        return self


def train(documents: DataFrame, labels: DataFrame, metadata: Sequence[str] = METADATA, setting: CoTrainingSetting = CoTrainingSetting()) -> Model:
    """A model from bounded samples of labelled and of unlabelled documents.

    `documents` holds doc_id, text and the columns of `metadata`; `labels` holds doc_id and good (0 or 1; null labels
    don't count). Without labels, or without both classes among them, nothing is rejected.
    """
    known = labels.where("good IS NOT NULL").select("doc_id", F.col("good").cast("int").alias("good"))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), *metadata)
    some = linear.bounded(texts, known, setting.labelled)
    fresh = documents.select("doc_id").join(known.select("doc_id"), "doc_id", "left_anti").distinct()
    fresh = linear.bounded(texts, fresh.withColumn("good", F.lit(None).cast("int")), setting.unlabelled)
    sample = stored(some.unionByName(fresh), "labelled")
    marked = sample.where("good IS NOT NULL").withColumn("bad", 1 - F.col("good"))
    sums = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    chosen = []
    for columns, extract, least in ((["text"], content_features, setting.least), (list(metadata), metadata_features, 0.0)):
        counts = linear.feature_counts(marked, columns, extract, ["bad"])
        chosen.append(linear.telling(counts, "bad", sums["n"], sums["bad"], setting.features, least))
    model = Model(*chosen)

    def encode(batch: pa.RecordBatch) -> pa.Table:
        values = [batch.column(c).to_pylist() for c in metadata]
        pairs = [model.numbers(t, row) for t, row in zip(batch.column("text").to_pylist(), zip(*values))]
        a, b = zip(*pairs)
        ints = pa.list_(pa.int32())
        return pa.table({"doc_id": batch.column("doc_id"), "good": batch.column("good"), "a": pa.array(a, ints), "b": pa.array(b, ints)})

    rows = batches(sample, encode, "doc_id long, good int, a array<int>, b array<int>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("good", "ascending")])
    y = np.array([np.nan if g is None else float(g) for g in rows.column("good").to_pylist()])
    views = [linear.Rows(rows.column(c).to_pylist()) for c in ("a", "b")]
    return model.fit(rows.column("doc_id").to_numpy(), views, y, setting)


def score(documents: DataFrame, model: Model, metadata: Sequence[str] = METADATA) -> DataFrame:
    """doc_id, quality (probability of a good text) and kept for every row of `documents`.

    A null text is like an empty one, a null in `metadata` a value of its own. Repeated rows get the same result; other
    columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as large as the bounds of its features

    def run(batch: pa.RecordBatch) -> pa.Table:
        model = shared.value
        values = [batch.column(c).to_pylist() for c in metadata]
        pairs = [model.numbers(t, row) for t, row in zip(batch.column("text").to_pylist(), zip(*values))]
        p = model.probability([linear.Rows([x[k] for x in pairs]) for k in (0, 1)])
        return pa.table({"doc_id": batch.column("doc_id"), "quality": pa.array(p), "kept": pa.array(p >= model.limit)})

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *metadata)
    return batches(source, run, "doc_id long, quality double, kept boolean")
