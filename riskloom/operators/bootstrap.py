"""Stratified bootstrap on counted cells.

Rows of a model with one score, label and class are a cell; a replicate is a count per cell. The counts come from the class
size by sequential splits: a balanced tree over the model's cells in order of score, where a node's draws part by a binomial
quantile of a number that depends only on (seed, model, class, replicate, node). So any part of the tree can be drawn alone,
and again: a task owns a block of cells, walks down from the root to it for its replicates, meets on the way how many draws lie
above it, and adds up what its cells give to the metrics. Rows are counted once; work is cells x replicates, and only one row of
sums per (block, replicate) is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.fixed import METRICS, REPLICATES, SEED
from riskloom.functions.binomial import binomial_quantile
from riskloom.operators.metrics import LABEL, SCORE, TRUTH, ratio, threshold_metrics
from riskloom.operators.ranking import range_cuts, running_totals
from riskloom.session import checkpoint, shuffle_partitions

MODEL = "model_name"
#: Leaves of a block, a power of two; a score has two leaves, one for each label.
BLOCK = 4096
#: Replicates that one task draws at once.
CHUNK = 250
#: Leaves x replicates that are held at once.
HELD = 1 << 20
#: Partitions that (block, chunk) are spread over at most, beyond those of a shuffle.
MOST_PIECES = 4096
COUNTS = ("pos_1", "pos_0", "neg_1", "neg_0")


def mixed(x: np.ndarray) -> np.ndarray:
    """32 bits spread over 32 bits."""
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(73244475) & np.uint64(0xFFFFFFFF)
    return x >> np.uint64(16) ^ x


def replicate_keys(seed: int, model: str, truth: int, replicates: range) -> np.ndarray:
    texts = (f"{seed}|{model}|{truth}|{b}" for b in replicates)
    return np.array([int(md5(t.encode()).hexdigest()[:8], 16) for t in texts], np.uint64)


def uniforms(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of 52 bits for 32-bit keys of (model, class, replicate) and nodes in heap order."""
    first = mixed((keys + nodes * np.uint64(2654435769)) & np.uint64(0xFFFFFFFF))
    second = mixed(first ^ keys)
    return ((first << np.uint64(20)) + (second >> np.uint64(12))).astype(float) / 2.0**52


class Tree:
    """The cells of one model above its blocks: leaves in all, and running counts of each class by block."""

    def __init__(self, scores: int, positives: np.ndarray, negatives: np.ndarray, block: int = BLOCK) -> None:
        self.block = block
        self.height = max(1, int(2 * scores - 1).bit_length())
        self.sums = {1: np.concatenate([[0], np.cumsum(positives)]), 0: np.concatenate([[0], np.cumsum(negatives)])}

    def upto(self, truth: int, leaf: int) -> int:
        """Rows of the class in leaves before `leaf`, a multiple of the block size."""
        sums = self.sums[truth]
        return int(sums[min(leaf // self.block, len(sums) - 1)])

    def walk(self, truth: int, block: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Draws in the block and before it, for each replicate, and the block's node in heap order."""
        size = int(self.sums[truth][-1])
        here, before, node = np.full(len(keys), size, np.int64), np.zeros(len(keys), np.int64), 1
        low, high = 0, 1 << self.height
        while high - low > self.block:
            middle = (low + high) // 2
            whole = self.upto(truth, high) - self.upto(truth, low)
            left = self.upto(truth, middle) - self.upto(truth, low)
            taken = binomial_quantile(uniforms(keys, np.uint64(node)), here, left / whole if whole else 0.0)
            if block * self.block < middle:
                high, here, node = middle, taken, 2 * node
            else:
                low, here, before, node = middle, here - taken, before + taken, 2 * node + 1
        return here, before, node


def leaf_draws(weights: np.ndarray, here: np.ndarray, keys: np.ndarray, node: int) -> np.ndarray:
    """Draws per leaf (rows: replicates) below `node`, whose leaves have these counts."""
    sums = np.concatenate([[0], np.cumsum(weights)])
    draws, first, size = here[:, None], node, len(weights)
    while draws.shape[1] < len(weights):
        size //= 2
        start = np.arange(draws.shape[1]) * 2 * size
        whole, left = sums[start + 2 * size] - sums[start], sums[start + size] - sums[start]
        share = np.divide(left, whole, out=np.zeros(len(left)), where=whole > 0)
        nodes = (first + np.arange(draws.shape[1])).astype(np.uint64)
        split = np.zeros_like(draws)
        rows, columns = np.nonzero((draws > 0) & (left > 0))
        split[rows, columns] = binomial_quantile(uniforms(keys[rows], nodes[columns]), draws[rows, columns], share[columns])
        draws = np.stack([split, draws - split], axis=2).reshape(len(draws), -1)
        first *= 2
    return draws


def counted_cells(predictions: DataFrame) -> DataFrame:
    """model, score, its place from the highest (0 ...), distinct scores of the model, and rows by class and label."""
    positive, said = F.col(TRUTH) == 1, F.coalesce(F.col(LABEL) == 1, F.lit(False))
    kinds = (positive & said, positive & ~said, ~positive & said, ~positive & ~said)
    missing = F.raise_error(F.lit("a prediction has no score")).cast(predictions.schema[SCORE].dataType)
    cells = predictions.groupBy(MODEL, F.coalesce(F.col(SCORE), missing).alias(SCORE)).agg(
        *[F.count_if(kind).alias(name) for name, kind in zip(COUNTS, kinds)], F.lit(1).alias("one")
    )
    ranked = running_totals(cells, [MODEL], SCORE, ["one"], range_cuts(predictions, SCORE))
    place = F.col("total_one") - 1 - F.col("before_one")
    return ranked.select(MODEL, F.col(SCORE).cast("double").alias(SCORE), place.alias("place"), F.col("total_one").alias("scores"), *COUNTS)


def block_sums(cells: pd.DataFrame, tree: Tree, number: int, keys: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
    """What the cells of a block give to the metrics of each replicate."""
    size = min(tree.block, 1 << tree.height)
    at = (2 * cells["place"].to_numpy() - number * tree.block).astype(np.int64)
    score = np.zeros(size // 2)
    score[at // 2] = cells[SCORE].to_numpy()
    weights = {}
    for truth, name in ((1, "pos"), (0, "neg")):
        weights[truth] = np.zeros(size, np.int64)
        weights[truth][at], weights[truth][at + 1] = cells[f"{name}_1"], cells[f"{name}_0"]
    step = max(1, HELD // size)
    for start in range(0, len(keys[1]), step):
        drawn, before = {}, {}
        for truth in (1, 0):
            key = keys[truth][start : start + step]
            here, before[truth], node = tree.walk(truth, number, key)
            drawn[truth] = leaf_draws(weights[truth], here, key, node)
        pos, neg = (drawn[t][:, 0::2] + drawn[t][:, 1::2] for t in (1, 0))
        tp = before[1][:, None] + np.cumsum(pos, axis=1)
        fp = before[0][:, None] + np.cumsum(neg, axis=1)
        wins = pos * (tree.sums[0][-1] - fp + neg / 2)
        precision = np.divide(tp, tp + fp, out=np.zeros(tp.shape), where=tp + fp > 0)
        yield pd.DataFrame(
            {"at": start + np.arange(len(pos)), "wins": wins.sum(1), "steps": (pos * precision).sum(1),
             "tp": drawn[1][:, 0::2].sum(1), "fp": drawn[0][:, 0::2].sum(1),
             "squares": (pos * (score - 1) ** 2 + neg * score**2).sum(1)}
        )


def bootstrap_metrics(
    predictions: DataFrame, replicates: int = REPLICATES, seed: int = SEED, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """The eight metrics of every model in every replicate; each class keeps its size.

    `predictions` has model_name, target_true, prediction_label and risk_score. Replicates of models are drawn on their own. One
    row per block (of `block` / 2 distinct scores) reaches the driver and goes to all tasks; `chunk` replicates are drawn in a task.
    """
    spark = predictions.sparkSession
    cells = checkpoint(counted_cells(predictions).withColumn("block", F.floor(2 * F.col("place") / block)))
    facts = cells.groupBy(MODEL, "block").agg(
        F.max("scores").alias("scores"), F.sum(F.col("pos_1") + F.col("pos_0")).alias("pos"), F.sum(F.col("neg_1") + F.col("neg_0")).alias("neg")
    )
    blocks = facts.toPandas().sort_values([MODEL, "block"]) if not cells.isEmpty() else pd.DataFrame({MODEL: []})
    trees = {m: Tree(int(b["scores"].iloc[0]), b["pos"].to_numpy(np.int64), b["neg"].to_numpy(np.int64), block) for m, b in blocks.groupby(MODEL, dropna=False)}
    shared = spark.sparkContext.broadcast(trees)
    chunks = range(0, replicates, chunk)
    spread = cells.withColumn("chunk", F.explode(F.array(*[F.lit(c) for c in chunks])))
    pieces = max(shuffle_partitions(spark), min(4 * len(blocks) * len(chunks), MOST_PIECES))
    spread = spread.repartition(pieces, MODEL, "block", "chunk")  # few bytes and much work: they must not be coalesced
    schema = f"{MODEL} string, replicate int, wins double, steps double, tp long, fp long, squares double"

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        model, first, number = cells[MODEL].iloc[0], int(cells["chunk"].iloc[0]), int(cells["block"].iloc[0])
        drawn = range(first + 1, min(first + chunk, replicates) + 1)
        keys = {t: replicate_keys(seed, model, t, drawn) for t in (1, 0)}
        out = pd.concat(block_sums(cells, shared.value[model], number, keys), ignore_index=True)
        out["replicate"], out[MODEL] = out["at"] + first + 1, model
        return out[[MODEL, "replicate", "wins", "steps", "tp", "fp", "squares"]]

    sums = spread.groupBy(MODEL, "block", "chunk").applyInPandas(solve, schema)
    totals = cells.groupBy(MODEL).agg(
        F.sum(F.col("pos_1") + F.col("pos_0")).alias("n_positive"), F.sum(F.col("neg_1") + F.col("neg_0")).alias("n_negative")
    )
    added = sums.groupBy(MODEL, "replicate").agg(*[F.sum(c).alias(c) for c in ("wins", "steps", "tp", "fp", "squares")])
    both = added.join(F.broadcast(totals), MODEL)  # one row per model
    rates = threshold_metrics(F.col("tp"), F.col("fp"), F.col("n_positive") - F.col("tp"), F.col("n_negative") - F.col("fp"))
    rates["auroc"] = ratio(F.col("wins"), F.col("n_positive").cast("double") * F.col("n_negative").cast("double"))
    rates["auprc"] = ratio(F.col("steps"), F.col("n_positive"))
    rates["brier_score"] = ratio(F.col("squares"), F.col("n_positive") + F.col("n_negative"))
    return both.select(
        MODEL, "replicate", (F.col("n_positive") + F.col("n_negative")).alias("n_rows"), "n_positive", "n_negative",
        *[rates[m].alias(m) for m in METRICS],
    )
