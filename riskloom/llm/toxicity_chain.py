"""Toxicity by a classifier chain.

Categories are predicted one after the other. The linear model of a category sees the features of the text and the
probabilities of all earlier categories; it is trained with out-of-fold probabilities, so that it does not trust them
more than they deserve on new texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import linear
from riskloom.llm.common import batches, stored

WORD = re.compile(r"[^\W_]+")
#: Common insults that part the labelled toxic rows into two categories, plain insults and other toxic wording.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile")
CATEGORIES = ("insult", "coded", "toxic")


@dataclass(frozen=True)
class ChainSetting:
    """sample: most labelled rows that are used; features: most features of one category, each with a
    chi-square of `least`; folds: of out-of-fold
    probabilities; ridge: weight of the penalty; cost: how many flagged toxic rows a flagged clean one outweighs.
    """

    sample: int = 6000
    features: int = 2000
    least: float = 60.0
    folds: int = 3
    ridge: float = 1.0
    cost: float = 5.0


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of three to five letters."""
    return [f"={word}", *(f"{word[:k]}*" for k in (3, 4, 5) if len(word) > k)]


def text_features(text: str | None) -> set[str]:
    return {f for word in words_of(text) for f in word_features(word)}


class Chain:
    def __init__(self, categories: Sequence[str], dictionary: linear.Dictionary, setting: ChainSetting) -> None:
        self.categories, self.dictionary, self.setting = tuple(categories), dictionary, setting
        self.models: list[linear.Logistic] = []
        self.limit = 0.5

    def fit(self, ids: np.ndarray, rows: linear.Rows, labels: np.ndarray) -> Chain:
        """labels: a column of 0 and 1 for each category."""
        width, fold, s = len(self.dictionary), linear.folds(ids, self.setting.folds), self.setting
        earlier = np.zeros((len(ids), 0))
        for k in range(len(self.categories)):
            y, held = labels[:, k].astype(np.float64), np.zeros(len(ids))
            for f in range(s.folds):
                part = linear.Logistic(width, k).fit(rows, earlier, y, (fold != f).astype(float), s.ridge)
                held[fold == f] = linear.sigmoid(part.score(rows, earlier))[fold == f]
            self.models.append(linear.Logistic(width, k).fit(rows, earlier, y, np.ones(len(ids)), s.ridge))
            earlier = np.column_stack([earlier, held])
        if len(ids):
            self.limit = linear.cut(earlier[:, -1], labels[:, -1] == 1, s.cost, 0.5)
        return self

    def probabilities(self, rows: linear.Rows) -> np.ndarray:
        earlier = np.zeros((rows.size, 0))
        for model in self.models:
            earlier = np.column_stack([earlier, linear.sigmoid(model.score(rows, earlier))])
        return earlier


def categories_of(labels: DataFrame, documents: DataFrame, setting: ChainSetting, insults: Sequence[str] = INSULTS) -> DataFrame:
    """A bounded sample of labelled texts: doc_id, text and a column of 0 or 1 for each of CATEGORIES.

    `labels` holds doc_id and toxic (0 or 1); null labels don't count. A toxic text with one of `insults` as a word is an
    insult, another toxic text is coded.
    """
    known = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = linear.bounded(texts, known, setting.sample)
    plain = F.lower(F.coalesce("text", F.lit(""))).rlike(r"(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, insults)) + r")(?![\p{L}\p{N}])")
    return sample.select(
        "doc_id", "text", (plain & (F.col("toxic") == 1)).cast("int").alias("insult"),
        (~plain & (F.col("toxic") == 1)).cast("int").alias("coded"), (F.col("toxic") == 1).cast("int").alias("toxic"),
    )


def train(sample: DataFrame, categories: Sequence[str] = CATEGORIES, setting: ChainSetting = ChainSetting()) -> Chain:
    """A chain from a bounded sample (doc_id, text, a column of 0 or 1 for each category; the last one decides).

    Features are counted and chosen in Spark; the chosen ones of each row, a few numbers, go to the fit on the driver.
    A category that no row or every row has gets a constant probability.
    """
    sample = stored(sample.select("doc_id", "text", *categories), "labelled")
    counts = stored(linear.feature_counts(sample, ["text"], text_features, categories), "features")
    sums = sample.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories)).first()
    names = [f for c in categories for f in linear.telling(counts, c, sums["n"], sums[c], setting.features, setting.least)]
    dictionary = linear.Dictionary(list(dict.fromkeys(names)), word_features)

    def encode(batch: pa.RecordBatch) -> pa.Table:
        ids = [sorted(dictionary.of(words_of(t))) for t in batch.column(1).to_pylist()]
        out = pa.table({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})
        for k, name in enumerate(categories):
            out = out.append_column(name, batch.column(2 + k))
        return out

    schema = "doc_id long, ids array<int>, " + ", ".join(f"{c} int" for c in categories)
    rows = batches(sample, encode, schema).toArrow().sort_by([("doc_id", "ascending")])
    labels = np.column_stack([rows.column(c).to_numpy() for c in categories])
    return Chain(categories, dictionary, setting).fit(rows.column("doc_id").to_numpy(), linear.Rows(rows.column("ids").to_pylist()), labels)


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, toxic, for every row of `documents` (doc_id, text).

    toxic says whether the last category's probability is above what the labelled rows ask for. A null or empty text has
    no features and gets the models' constants, but is never toxic. Repeated rows get the same result; other columns are
    ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)  # as large as the bounds of its features

    def run(batch: pa.RecordBatch) -> pa.Table:
        chain = shared.value
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        p = chain.probabilities(linear.Rows([tuple(chain.dictionary.of(w)) for w in words]))
        toxic = (p[:, -1] >= chain.limit) & np.array([bool(w) for w in words])
        out = {"doc_id": batch.column(0), **{f"p_{c}": pa.array(p[:, k]) for k, c in enumerate(chain.categories)}}
        return pa.table({**out, "toxic": pa.array(toxic)})

    schema = "doc_id long, " + "".join(f"p_{c} double, " for c in chain.categories) + "toxic boolean"
    return batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
