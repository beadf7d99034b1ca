"""Histogram gradient boosting of a binary target.

Features are cut into at most 255 bins, and rows with the same bins are one cell with its counts of both classes. A level of a
tree needs the sums of gradients and hessians per (node, feature, bin). Up to `held` cells a single task grows all trees over
them; beyond that every level is one pass over the cells, whose scores are written every `KEPT` rounds, and only the sums - nodes
x features x bins, once per partition - reach the driver. Both ways find the same splits.

Most cells share one bin of a one-hot feature: only the others are added up, and that bin gets what is left of its node.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskloom.session import checkpoint

BINS = 255
#: Rounds after which the scores of distributed cells are written; the trees since then are added while passing over them.
KEPT = 20
#: Cells of a partition at least, and partitions at most.
PIECE, PIECES = 16_384, 64
Histogram = Callable[[list["Tree"], int], np.ndarray]


@dataclass(frozen=True)
class BoostSetting:
    """Rounds, learning rate, depth, penalty on leaf values, least hessian sum of a child; held: most cells that one task takes."""

    rounds: int = 300
    step: float = 0.05
    depth: int = 4
    penalty: float = 1.0
    least: float = 1.0
    held: int = 200_000


class Tree:
    """A full tree in heap order from node 1: a row goes left if its bin of the node's feature is at most `upto`.

    A node that doesn't split sends all rows left. `values` are those of the leaves.
    """

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.feature = np.zeros(1 << depth, np.int32)
        self.upto = np.full(1 << depth, BINS, np.int32)
        self.values = np.zeros(1 << depth)

    def node(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Place of each row among the nodes of a level."""
        node = np.ones(len(bins), np.int64)
        for _ in range(level):
            node = 2 * node + (bins[np.arange(len(bins)), self.feature[node]] > self.upto[node])
        return node - (1 << level)

    def score(self, bins: np.ndarray) -> np.ndarray:
        return self.values[self.node(bins, self.depth)]

    def packed(self) -> list[list]:
        return [self.feature.tolist(), self.upto.tolist(), self.values.tolist()]

    @classmethod
    def unpacked(cls, parts: list[list]) -> Tree:
        tree = cls(len(parts[0]).bit_length() - 1)
        tree.feature, tree.upto, tree.values = np.array(parts[0], np.int32), np.array(parts[1], np.int32), np.array(parts[2], float)
        return tree


class Cells:
    """Bins of cells, with the places that are not in the commonest bin of a feature where most cells share one."""

    def __init__(self, bins: np.ndarray) -> None:
        self.bins, self.features = bins, []
        for f in range(bins.shape[1]):
            counts = np.bincount(bins[:, f], minlength=BINS + 1)
            common = int(counts.argmax())
            rare = np.flatnonzero(bins[:, f] != common) if 2 * counts[common] > len(bins) else None
            self.features.append((common, rare, bins[:, f].astype(np.int64) if rare is None else bins[rare, f].astype(np.int64), int(counts.nonzero()[0].max(initial=0)) + 1))


def sums(cells: Cells, node: np.ndarray, nodes: int, values: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sums of `values` by (value, node, feature, bin)."""
    out = np.zeros((len(values), nodes, len(cells.features), BINS + 1))
    size = np.bincount(node, minlength=nodes)
    whole = [np.bincount(node, v, nodes) for v in values]
    for f, (common, rare, bins, width) in enumerate(cells.features):
        at = (node if rare is None else node[rare]) * width + bins
        for i, v in enumerate(values):
            out[i, :, f, :width] = np.bincount(at, v if rare is None else v[rare], nodes * width).reshape(nodes, -1)
        if rare is not None:
            held = size > np.bincount(node[rare], minlength=nodes)  # no rounding where the node has none of that bin
            for i in range(len(values)):
                out[i, :, f, common] = np.where(held, whole[i] - out[i, :, f].sum(1), 0.0)
    return out


def slopes(score: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the logistic loss of cells."""
    p = 1 / (1 + np.exp(-score))
    rows = positive + negative
    return positive - rows * p, rows * p * (1 - p)


def grow(histogram: Callable[[Tree, int], np.ndarray], setting: BoostSetting) -> Tree:
    """A tree level by level; of equal gains the first feature and the lowest bin count."""
    tree = Tree(setting.depth)
    for level in range(setting.depth):
        g, h = histogram(tree, level)
        left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
        all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        k = setting.penalty
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + k) + right_g**2 / (right_h + k) - all_g**2 / (all_h + k)
        gain = np.where((left_h >= setting.least) & (right_h >= setting.least) & (left_h > 0) & (right_h > 0), gain, 0.0)
        gain = np.nan_to_num(gain, nan=0.0).reshape(len(gain), -1)
        best = gain.argmax(1)
        node = (1 << level) + np.arange(len(gain))
        split = gain[np.arange(len(gain)), best] > 1e-12
        tree.feature[node] = np.where(split, best // (BINS + 1), 0)
        tree.upto[node] = np.where(split, best % (BINS + 1), BINS)
    every = np.arange(len(gain))  # of the last level's sums: what lies left and right of each split are the leaves
    found = tree.feature[node], tree.upto[node]
    g, h = (np.stack([left[every, *found], whole[:, 0, 0] - left[every, *found]], axis=1).ravel() for left, whole in ((left_g, all_g), (left_h, all_h)))
    h = np.where(np.repeat(split, 2) | (np.arange(len(h)) % 2 == 0), h, 0.0)  # a node that doesn't split sends all rows left
    g = np.where(h > 0, g, 0.0)
    tree.values = setting.step * np.divide(g, h + setting.penalty, out=np.zeros(len(g)), where=h + setting.penalty > 0)
    return tree


def grow_all(bins: np.ndarray, positive: np.ndarray, negative: np.ndarray, setting: BoostSetting) -> list[Tree]:
    """All trees over cells that fit one task."""
    score, trees, cells = np.zeros(len(bins)), [], Cells(bins)
    for _ in range(setting.rounds):
        g, h = slopes(score, positive, negative)
        tree = grow(lambda t, level: sums(cells, t.node(bins, level), 1 << level, (g, h)), setting)
        score += tree.score(bins)
        trees.append(tree)
    return trees


def grow_over(cells: DataFrame, width: int, setting: BoostSetting) -> list[Tree]:
    """All trees over a table of cells (bins, positive, negative), one pass per level.

    Each partition adds up its cells and sends its sums packed: at most `PIECES` times nodes x features x bins a level.
    """
    trees: list[Tree] = []
    pieces = min(PIECES, max(1, -(-cells.count() // PIECE)))
    scored = checkpoint(cells.withColumn("score", F.lit(0.0)).repartition(pieces, "bins"))
    for number in range(setting.rounds):
        since = trees[number - number % KEPT :]

        def histogram(tree: Tree, level: int) -> np.ndarray:
            nodes = 1 << level

            def part(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros((2, nodes, width, BINS + 1))
                for batch in source:
                    if len(batch):
                        bins = unpack(batch["bins"], width)
                        score = sum((t.score(bins) for t in since), batch["score"].to_numpy())
                        values = slopes(score, batch["positive"].to_numpy(float), batch["negative"].to_numpy(float))
                        total += sums(Cells(bins), tree.node(bins, level), nodes, values)
                place = np.flatnonzero(total)
                yield pd.DataFrame({"place": [place.tobytes()], "value": [total.ravel()[place].tobytes()]})

            out = np.zeros(2 * nodes * width * (BINS + 1))
            for row in scored.mapInPandas(part, "place binary, value binary").collect():
                out[np.frombuffer(row["place"], np.int64)] += np.frombuffer(row["value"])
            return out.reshape(2, nodes, width, BINS + 1)

        trees.append(grow(histogram, setting))
        if len(trees) % KEPT == 0:
            since = trees[-KEPT:]

            def moved(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in source:
                    bins = unpack(batch["bins"], width)
                    yield batch.assign(score=sum((t.score(bins) for t in since), batch["score"].to_numpy()))

            scored = checkpoint(scored.mapInPandas(moved, scored.schema))
    return trees


def unpack(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), width)


def place(rows: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bins of features: 0 for NaN, else one more than the cuts below the value."""
    out = np.zeros(rows.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(rows[:, f]), 0, 1 + np.searchsorted(np.array(c), rows[:, f], side="left"))
    return out


def feature_cuts(vectors: DataFrame, column: str, width: int) -> list[list[float]]:
    """At most 253 cuts per feature, about equally many rows apart; values that stand between two cuts share a bin."""
    values = vectors.select(*[F.nanvl(vector_to_array(column)[f], F.lit(None).cast("double")).alias(f"f{f}") for f in range(width)])
    shares = [i / 253 for i in range(254)]
    found = values.approxQuantile(values.columns, shares, 0.0005)
    return [sorted(set(c))[:-1] for c in found]  # nothing lies above the greatest


def cells_of(vectors: DataFrame, features: str, label: str, cuts: list[list[float]]) -> DataFrame:
    """Rows per distinct bins: bins (a byte per feature), positive, negative."""

    @pandas_udf("binary")
    def binned(column: pd.Series) -> pd.Series:
        rows = np.stack(column.to_list()) if len(column) else np.zeros((0, len(cuts)))
        return pd.Series([r.tobytes() for r in place(rows, cuts)])

    truth = F.col(label).cast("int")
    rows = vectors.select(binned(vector_to_array(features)).alias("bins"), truth.alias("truth"))
    return rows.groupBy("bins").agg(F.count_if(F.col("truth") == 1).alias("positive"), F.count_if(F.col("truth") == 0).alias("negative"))


def boost(vectors: DataFrame, features: str, label: str, setting: BoostSetting = BoostSetting()) -> tuple[list[list[float]], list[Tree]]:
    """Cuts and trees for rows with a feature vector and a label of 0 or 1."""
    first = vectors.select(features).first()
    width = len(first[0]) if first else 0
    if not width:
        return [], []
    cuts = feature_cuts(vectors, features, width)
    cells = checkpoint(cells_of(vectors, features, label, cuts))
    if cells.count() > setting.held:
        return cuts, grow_over(cells, width, setting)

    def one_task(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("bins")
        trees = grow_all(unpack(ordered["bins"], width), ordered["positive"].to_numpy(float), ordered["negative"].to_numpy(float), setting)
        return pd.DataFrame({"trees": [json.dumps([t.packed() for t in trees])]})

    rows = cells.groupBy().applyInPandas(one_task, "trees string").collect()
    return cuts, [Tree.unpacked(t) for t in json.loads(rows[0]["trees"])]


# --- Spark ML stages ---------------------------------------------------------------------------------------------------


class HistogramBoosting(Estimator, HasFeaturesCol, HasLabelCol):
    """Estimator of `HistogramBoostingModel`."""

    def __init__(self, setting: BoostSetting = BoostSetting(), featuresCol: str = "features", labelCol: str = "label") -> None:
        super().__init__()
        self.setting = setting
        self._set(featuresCol=featuresCol, labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> HistogramBoostingModel:
        cuts, trees = boost(dataset, self.getFeaturesCol(), self.getLabelCol(), self.setting)
        return HistogramBoostingModel(featuresCol=self.getFeaturesCol(), trees=json.dumps([cuts, [t.packed() for t in trees]]))


class HistogramBoostingModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds probability (a vector of both classes) and prediction. Its cuts and trees are one parameter, as JSON."""

    trees = Param(Params._dummy(), "trees", "cuts and trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol: str = "features", trees: str = "[[], []]") -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts, packed = json.loads(self.getOrDefault(self.trees))
        trees = [Tree.unpacked(t) for t in packed]

        @pandas_udf("double")
        def chance(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype=float)
            bins = place(np.stack(column.to_list()), cuts)
            score = sum((t.score(bins) for t in trees), np.zeros(len(bins)))
            return pd.Series(1 / (1 + np.exp(-score)))

        scored = dataset.withColumn("_chance", chance(vector_to_array(self.getFeaturesCol())))
        both = array_to_vector(F.array(1 - F.col("_chance"), F.col("_chance")))
        return scored.withColumns({"probability": both, "prediction": (F.col("_chance") > 0.5).cast("double")}).drop("_chance")
