"""Quality rules: an isolation forest over rule statistics.

Every document gets the counts that quality rules look at. Trees of random splits over rates of these counts give each
document a mean path length; short paths mark documents that differ from the rest. The good and bad rows among all labelled
ones say from which anomaly score on a document goes. A few fixed rules reject a document before that.

The cuts of a tree are drawn at random and need no rows but the range of each rate. All labelled rows count for the rest: for
the ranges, for what each node holds and for the threshold; nothing is sampled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import batches, stored
from riskloom.operators.ranking import range_cuts, running_totals

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
STATISTICS = pa.schema([("doc_id", pa.int64()), *((name, pa.int64()) for name in COUNTS)])


@dataclass(frozen=True)
class ForestSetting:
    """trees that part the ordinary rows as finely as `tree_rows` rows can be parted: a node with one in so many is a leaf.

    cost: how many rejected bad rows a rejected good row outweighs when the threshold is set.
    """

    trees: int = 100
    tree_rows: int = 256
    cost: float = 20.0
    seed: int = 7


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which stands at two or more places."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids
    for width in range(1, window):  # numbers of windows of 2, 3, ... words, without a hash
        _, key = np.unique(key[: len(words) - width] * len(number) + ids[width:], return_inverse=True)
        if key.max() + 1 == len(key):
            return 0
    again = np.bincount(key)[key] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(again)] += again
    edges[window:] -= again
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text; null counts as empty."""
    text = text or ""
    data = text.encode()
    words = data.split()  # at the six ASCII spaces
    lines = Counter(line for line in text.split("\n") if line.strip(SPACE))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        lines.total() - len(lines),
        repeated_words(words),
        lines.total(),
        len(data) - len(data.translate(None, CAPITALS)),
        text.count("!") + text.count("?"),
    )


def rule_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and COUNTS for every row of `documents` (doc_id, text)."""

    def count(batch: pa.RecordBatch) -> pa.Table:
        rows = [statistics(text) for text in batch.column(1).to_pylist()]
        columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
        return pa.Table.from_arrays([batch.column(0), *columns], schema=STATISTICS)

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return batches(source, count, ", ".join(f"{f.name} long" for f in STATISTICS))


HALF = 0.05


def rates(counts: np.ndarray) -> np.ndarray:
    """Rates that don't grow with the length of a text, from rows of COUNTS; HALF becomes a half, large ones near 1."""
    words, chars, symbols, same, repeated, lines, capitals, marks = counts.astype(np.float64).T
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    raw = np.column_stack([symbols / n, same / np.maximum(lines, 1), repeated / n, capitals / c, marks / n])
    return raw / (raw + HALF)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a search that misses in a random tree of n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random trees as arrays: node k has the children 2k + 1 and 2k + 2; a leaf holds the path length that ends there.

    Cuts are drawn over the range that all labelled rows span, and `close` then counts the ordinary ones in each node: a row
    where no ordinary one lies soon stands alone.
    """

    def __init__(self, ordinary: int, low: np.ndarray, high: np.ndarray, setting: ForestSetting) -> None:
        self.size = min(ordinary, setting.tree_rows)
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.unit = float(max(mean_path(self.size), 1e-9))
        shape = (setting.trees, 2 ** (self.depth + 1) - 1)
        self.feature, self.cut, self.path = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
        draw = np.random.default_rng(setting.seed)
        for tree in range(setting.trees):
            self._cut(tree, 0, 0, low, high, draw)

    def _cut(self, tree: int, node: int, depth: int, low, high, draw: np.random.Generator) -> None:
        open_features = np.flatnonzero(high > low)
        if depth == self.depth or not len(open_features):
            return
        k = draw.choice(open_features)
        self.feature[tree, node] = k
        self.cut[tree, node] = cut = draw.uniform(low[k], high[k])
        upper, lower = high.copy(), low.copy()
        upper[k] = lower[k] = cut
        self._cut(tree, 2 * node + 1, depth + 1, low, upper, draw)
        self._cut(tree, 2 * node + 2, depth + 1, lower, high, draw)

    def ends(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The node where each row ends, tree by tree."""
        every = np.arange(len(rows))
        for feature, cut in zip(self.feature, self.cut):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                k = feature[node]
                child = 2 * node + 1 + (rows[every, k] >= cut[node])
                node = np.where(k >= 0, child, node)
            yield node

    def counted(self, rows: np.ndarray) -> np.ndarray:
        """How many of the rows end in each node of each tree."""
        return np.array([np.bincount(node, minlength=self.feature.shape[1]) for node in self.ends(rows)], np.int64)

    def close(self, counts: np.ndarray) -> None:
        """Set paths from the ordinary rows that end in each node; what holds one of `size` rows or less is a leaf."""
        inside = counts.astype(np.float64)
        for node in range(inside.shape[1] // 2 - 1, -1, -1):
            inside[:, node] += inside[:, 2 * node + 1] + inside[:, 2 * node + 2]
        share = self.size * inside / np.maximum(inside[:, :1], 1)
        level = np.floor(np.log2(np.arange(inside.shape[1]) + 1))
        whole = np.arange(self.size + 1)
        self.feature[share <= 1] = -1
        self.path = level + np.interp(share, whole, mean_path(whole))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, between 0 and 1: 2 to the minus mean path length over the usual one."""
        total = np.zeros(len(rows))
        for node, path in zip(self.ends(rows), self.path):
            total += path[node]
        return 2.0 ** (-total / (len(self.feature) * self.unit))


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """Rates of a batch with the columns COUNTS."""
    return rates(np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in COUNTS]))


def fit(labelled: DataFrame, setting: ForestSetting) -> Forest | None:
    """A forest for rows of COUNTS and good, all of which count; None if there are none.

    Each task adds up its own rows: a row of ranges, then a row per node (of `trees` times twice `tree_rows`) that it met.
    """

    def spans(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                rows = rows_of(batch)
                cells = [*rows.min(0), *rows.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.float64()) for c in cells], names=names)

    width = rates(np.zeros((0, len(COUNTS)))).shape[1]
    names = [f"{end}{k}" for end in ("low", "high") for k in range(width)]
    met = labelled.mapInArrow(spans, ", ".join(f"{n} double" for n in names))
    ends = met.agg(*[(F.min if n.startswith("low") else F.max)(n).alias(n) for n in names]).first()
    if ends["low0"] is None:
        return None
    good = labelled.where("good = 1").count()
    ordinary = labelled.where("good = 1") if good else labelled
    low, high = (np.array([ends[f"{end}{k}"] for k in range(width)]) for end in ("low", "high"))
    forest = Forest(good or labelled.count(), low, high, setting)
    shared = labelled.sparkSession.sparkContext.broadcast(forest)  # fixed number of trees and nodes

    def tally(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shared.value.feature.shape, np.int64)
        for batch in source:
            counts += shared.value.counted(rows_of(batch))
        place = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(counts.ravel()[place], pa.int64())], names=["place", "n"])

    met = ordinary.mapInArrow(tally, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(forest.feature.size, np.int64)
    counts[met["place"].to_numpy()] = met["n"].to_numpy()
    forest.close(counts.reshape(forest.feature.shape))
    return forest


def threshold(scored: DataFrame, cost: float) -> float:
    """The score from which on rejecting gains most: rejected bad rows less `cost` times rejected good ones.

    `scored` has score and good of all labelled rows; of equal gains the highest score counts.
    """
    good = F.col("good") == 1
    sums = scored.groupBy("score").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    ordered = running_totals(sums, [], "score", ["good", "bad"], range_cuts(scored, "score"))
    gain = F.col("total_bad") - F.col("before_bad") - F.lit(float(cost)) * (F.col("total_good") - F.col("before_good"))
    best = ordered.agg(F.max(F.struct(gain.alias("gain"), F.col("score").alias("score")))).first()[0]
    return float(best["score"]) if best is not None and best["gain"] > 0 else np.inf


def judge(documents: DataFrame, labels: DataFrame, setting: ForestSetting = ForestSetting()) -> DataFrame:
    """Counts, base rules, anomaly score and verdict of every document.

    `documents` holds doc_id and text, `labels` doc_id and good (0 or 1) of some of them; a document with several labels
    counts with each, and null labels don't count. Returns doc_id, COUNTS, base_failed, score and kept. A null or empty
    text has no words and fails the base rules. Without labelled bad rows the forest rejects nothing. Rows are judged one
    by one, so repeated ones get the same verdict; other columns are ignored.
    """
    counted = stored(rule_statistics(documents), "rule_statistics")
    known = labels.where("good IS NOT NULL").select("doc_id", F.col("good").cast("int").alias("good"))
    labelled = stored(counted.join(known, "doc_id").select(*COUNTS, "good"), "rule_labels")
    forest, limit, context = fit(labelled, setting), np.inf, documents.sparkSession.sparkContext
    if forest is not None:
        fitted = context.broadcast(forest)

        def scored(batch: pa.RecordBatch) -> pa.Table:
            return pa.table({"score": fitted.value.score(rows_of(batch)), "good": batch.column("good")})

        limit = threshold(stored(batches(labelled, scored, "score double, good int"), "rule_scores"), setting.cost)
    shared = context.broadcast((forest, limit))  # fixed number of trees and nodes

    def decide(batch: pa.RecordBatch) -> pa.Table:
        counts = np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in COUNTS])
        forest, limit = shared.value
        score = np.zeros(len(counts)) if forest is None else forest.score(rates(counts))
        words, repeated = counts[:, 0], counts[:, 4]
        failed = (words < 10) | (100 * repeated > 20 * words)
        extra = {"base_failed": failed, "score": score, "kept": ~failed & (score < limit)}
        table = pa.Table.from_batches([batch])
        for name, column in extra.items():
            table = table.append_column(name, pa.array(column))
        return table

    schema = ", ".join(f"{name} long" for name in ("doc_id", *COUNTS)) + ", base_failed boolean, score double, kept boolean"
    return batches(counted, decide, schema)
