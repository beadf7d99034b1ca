"""Codes for vectors: codebooks of whole-number entries, trained by dual-tree Lloyd rounds.

A vector is cut into parts, and every part position has a codebook. Rows are kept in blocks; a block holds one tree per
part position over its parts (balanced, split at the median of the widest component) with the box of every node and
running sums. A round builds a small tree over the entries and goes down both trees together: a pair of nodes goes when
its least distance is above the largest distance of another pair of the same data node. A data node with one entry left
is assigned whole, by its cached sums; the parts of leaves that stay open are compared with their open entries in
integers. Sums of blocks are added by Spark, and only the codebooks (parts x entries) pass through the driver.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices, stored

#: Squared distances below this are computed in 64 bits, larger ones in Python's integers.
SAFE = 1 << 62
LIMB = 32


@dataclass(frozen=True)
class CodeSetting:
    """parts, entries of a codebook, Lloyd rounds; scale: integers per unit; leaf: most parts in a leaf of a block's tree;
    block: about how many bytes of vectors a block holds.
    """

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    leaf: int = 16
    block: int = 4 << 20


# --- Trees -------------------------------------------------------------------------------------------------------------


def bounds_of(n: int, level: int) -> np.ndarray:
    """First places of the 2^level nodes of a balanced tree over n rows, and n."""
    return (np.arange((1 << level) + 1) * n) >> level


class Tree:
    """A balanced tree over the rows of a whole-number matrix.

    order: the row at each place; rows: the matrix in that order; low, high: boxes of the nodes by level; sums: running
    sums of the rows, so that a node's sum is a difference. A node without rows has no meaning.
    """

    def __init__(self, rows: np.ndarray, leaf: int) -> None:
        n, self.order = len(rows), np.arange(len(rows))
        self.levels = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        for level in range(self.levels):  # split every node at the median of its widest component
            first = bounds_of(n, level)
            filled = np.flatnonzero(first[1:] > first[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(first))
            moved = rows[self.order]
            spread = np.maximum.reduceat(moved, first[filled]) - np.minimum.reduceat(moved, first[filled])
            widest = np.zeros(1 << level, np.int64)
            widest[filled] = spread.argmax(1)
            self.order = self.order[np.lexsort((ranks(moved[np.arange(n), widest[node]]), node))]
        self._measure(rows[self.order])

    def _measure(self, rows: np.ndarray) -> None:
        n, self.rows = len(rows), rows
        self.low, self.high, self.first = [], [], []
        for level in range(self.levels + 1):
            first = bounds_of(n, level)
            filled = np.flatnonzero(first[1:] > first[:-1])
            low = np.zeros((1 << level, rows.shape[1]), rows.dtype)
            high = low.copy()
            if len(filled):
                low[filled] = np.minimum.reduceat(rows, first[filled])
                high[filled] = np.maximum.reduceat(rows, first[filled])
            self.low.append(low), self.high.append(high), self.first.append(first)
        self.sums = np.concatenate([np.zeros((1, rows.shape[1]), rows.dtype), rows.cumsum(0)])

    def save(self) -> dict[str, np.ndarray]:
        text = self.rows.dtype == object  # wide integers are kept as text
        return {"order": self.order.astype(np.int32), "rows": self.rows.astype(str) if text else self.rows, "levels": np.array(self.levels)}

    @classmethod
    def load(cls, saved: dict[str, np.ndarray]) -> Tree:
        tree, rows = cls.__new__(cls), saved["rows"]
        if rows.dtype.kind == "U":
            rows = wide([[int(x) for x in row] for row in rows], rows.shape)
        tree.order, tree.levels = saved["order"], int(saved["levels"])
        tree._measure(rows)
        return tree


def wide(rows: list, shape: tuple[int, int]) -> np.ndarray:
    """A matrix of Python integers."""
    out = np.empty(shape, object)
    for i, row in enumerate(rows):
        out[i, :] = row
    return out


def ranks(values: np.ndarray) -> np.ndarray:
    """Numbers in the order of `values`, for sorting by Python's integers."""
    return np.unique(values, return_inverse=True)[1] if values.dtype == object else values


def squared(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)


@dataclass
class Assigned:
    """entry of every place of a tree; whole: how many rows were assigned with their node; sums and counts by entry."""

    entry: np.ndarray
    whole: int
    sums: np.ndarray
    counts: np.ndarray


def assign(tree: Tree, codebook: list[list[int]]) -> Assigned:
    """Nearest entries (squared distance, ties to the lower index) of all rows of `tree`, by going down both trees."""
    n, width = tree.rows.shape
    out = Assigned(np.zeros(n, np.int64), 0, wide([[0] * width] * len(codebook), (len(codebook), width)), np.zeros(len(codebook), np.int64))
    if not n:
        return out
    open_entries = possible(tree, codebook)
    reach = max((abs(x) for e in open_entries for x in codebook[e]), default=0)
    span = max(abs(int(x)) for x in [0, *tree.low[0].ravel(), *tree.high[0].ravel()])
    kind = np.int64 if width * (reach + span) ** 2 < SAFE and tree.rows.dtype != object else object
    points = wide([codebook[e] for e in open_entries], (len(open_entries), width)).astype(kind)
    over = Tree(points, 1)  # `order` leads back to open_entries
    numbers = np.array(open_entries)[over.order]
    node, other, level, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        low, high = tree.low[level][node].astype(kind), tree.high[level][node].astype(kind)
        below, above = over.low[depth][other], over.high[depth][other]
        zero = np.zeros_like(low)
        least = squared(np.maximum(np.maximum(below - high, low - above), zero))
        most = squared(np.maximum(above - low, high - below))
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        group = np.cumsum(np.r_[False, node[1:] != node[:-1]])
        keep = (least <= np.minimum.reduceat(most, start)[group]).astype(bool)
        node, other = node[keep], other[keep]
        if depth == over.levels:
            node, other = closer(tree, over, numbers, level, node, other, kind)
            alone = np.bincount(node, minlength=1 << level)[node] == 1
            if alone.any():
                first = tree.first[level]
                for at, e in zip(node[alone], numbers[over.first[depth][other[alone]]]):
                    a, b = first[at], first[at + 1]
                    out.entry[a:b] = e
                    out.whole += int(b - a)
                    out.sums[e] += (tree.sums[b] - tree.sums[a]).astype(object)
                    out.counts[e] += b - a
                node, other = node[~alone], other[~alone]
            if level == tree.levels or not len(node):
                break
        down, deeper = level < tree.levels, depth < over.levels
        node, other = expand(node, other, down, deeper, tree.first[level + down], over.first[depth + deeper])
        level, depth = level + down, depth + deeper
    if len(node):
        settle(tree, over, numbers, level, node, other, kind, out)
    return out


def possible(tree: Tree, codebook: list[list[int]]) -> list[int]:
    """Entries that may be nearest to a row in the root's box; of equal entries the first. In Python's integers."""
    low, high = [int(x) for x in tree.low[0][0]], [int(x) for x in tree.high[0][0]]
    unique = {tuple(entry): e for e, entry in reversed(list(enumerate(codebook)))}
    least = {e: sum(max(c - b, a - c, 0) ** 2 for a, b, c in zip(low, high, entry)) for entry, e in unique.items()}
    most = min(sum(max(c - a, b - c) ** 2 for a, b, c in zip(low, high, entry)) for entry in unique)
    return sorted(e for e, d in least.items() if d <= most)


def closer(tree, over, numbers, level, node, other, kind) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes and entries without those where another entry is nearer in the whole box.

    The difference of two squared distances is linear in the row, so its least value over a box is at a corner.
    """
    if not len(node):
        return node, other
    at = over.first[over.levels][other]
    entry, number = over.rows[at], numbers[at]
    low, high = tree.low[level][node].astype(kind), tree.high[level][node].astype(kind)
    most = squared(np.maximum(entry - low, high - entry))
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    group = np.cumsum(np.r_[False, node[1:] != node[:-1]])
    best = np.lexsort((number, ranks(most), group))[start][group]
    step = entry - entry[best]  # d(x, entry) - d(x, best) = |entry|^2 - |best|^2 - 2 x step
    least = (entry * entry - entry[best] * entry[best] - 2 * np.maximum(low * step, high * step)).sum(1)
    keep = ((least < 0) | ((least == 0) & (number <= number[best]))).astype(bool)
    return node[keep], other[keep]


def expand(node, other, down, deeper, first, over_first) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children, ordered by data node; nodes without rows go."""
    if deeper:
        node, other = np.repeat(node, 2), np.repeat(other * 2, 2) + np.tile([0, 1], len(other))
        filled = over_first[other + 1] > over_first[other]
        node, other = node[filled], other[filled]
    if down:
        node, other = np.concatenate([node * 2, node * 2 + 1]), np.concatenate([other, other])
        order = np.argsort(node, kind="stable")
        node, other = node[order], other[order]
        filled = first[node + 1] > first[node]
        node, other = node[filled], other[filled]
    return node, other


def settle(tree, over, numbers, level, node, other, kind, out: Assigned) -> None:
    """Rows of open leaves against their open entries, in integers."""
    first = tree.first[level]
    size = first[node + 1] - first[node]
    pair = np.repeat(np.arange(len(node)), size)
    row = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + first[node][pair]
    at = over.first[over.levels][other][pair]
    number = numbers[at]
    dist = squared(tree.rows[row].astype(kind) - over.rows[at])
    order = np.lexsort((number, ranks(dist), row))
    row, number = row[order], number[order]
    best = np.r_[True, row[1:] != row[:-1]]
    row, number = row[best], number[best]
    out.entry[row] = number
    for e in np.unique(number):
        chosen = row[number == e]
        out.sums[e] += tree.rows[chosen].sum(0).astype(object)
        out.counts[e] += len(chosen)


# --- Tables ------------------------------------------------------------------------------------------------------------


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles; of Python's integers where they are large."""
    if not values.size or np.abs(values).max() * scale < 1 << 40:
        return np.floor(values * scale).astype(np.int64)
    flat = [int(Fraction(x) * scale // 1) for x in values.ravel().tolist()]
    return wide(np.array(flat, object).reshape(values.shape).tolist(), values.shape)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and label of the rows whose vector is there and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v"), "label").where(F.col("v").isNotNull()).where(~odd)


def blocks(rows: DataFrame, setting: CodeSetting) -> DataFrame:
    """ids, labels and trees (one for each part) of blocks of rows."""
    label = rows.schema["label"].dataType.simpleString()

    def build(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in slices(batch, setting.block):
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                arrays = {}
                for p, piece in enumerate(np.split(whole_numbers(values, setting.scale), setting.parts, axis=1)):
                    arrays |= {f"{name}{p}": a for name, a in Tree(piece, setting.leaf).save().items()}
                buffer = io.BytesIO()
                np.savez(buffer, **arrays)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([buffer.getvalue()], pa.binary())], names=["ids", "labels", "trees"])

    return rows.select("vec_id", "v", "label").mapInArrow(build, f"ids array<bigint>, labels array<{label}>, trees binary")


def trees_of(data: bytes, parts: int) -> list[Tree]:
    saved = np.load(io.BytesIO(data))
    return [Tree.load({name: saved[f"{name}{p}"] for name in ("order", "rows", "levels")}) for p in range(parts)]


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(i, limb) with the sum of limb << (32 * i) equal to `value`; limbs have its sign."""
    sign, value, i = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & 0xFFFFFFFF:
            yield i, sign * (value & 0xFFFFFFFF)
        value, i = value >> LIMB, i + 1


def improved(held: DataFrame, codebooks: list[list[list[int]]], setting: CodeSetting) -> tuple[list[list[list[int]]], int]:
    """Codebooks after one more round, and how many parts were assigned with a whole node."""
    shared = held.sparkSession.sparkContext.broadcast(codebooks)  # parts x entries

    def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for data in batch.column(0):
                rows = []
                for p, tree in enumerate(trees_of(data.as_py(), setting.parts)):
                    found = assign(tree, shared.value[p])
                    rows.append((p, -2, -1, 0, found.whole))
                    for e in np.flatnonzero(found.counts).tolist():
                        rows.append((p, e, -1, 0, int(found.counts[e])))
                        rows += [(p, e, at, i, x) for at, total in enumerate(found.sums[e]) for i, x in limbs(int(total))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 4 + [pa.int64()])]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "limb", "value"])

    rows = held.select("trees").mapInArrow(sums, "part int, entry int, place int, limb int, value long")
    added = rows.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
    whole = sum(r.value for r in added if r.entry == -2)
    counts = {(r.part, r.entry): r.value for r in added if r.place == -1 and r.entry >= 0}
    totals: dict[tuple[int, int], list[int]] = {}
    for r in added:
        if r.place >= 0:
            total = totals.setdefault((r.part, r.entry), [0] * len(codebooks[r.part][r.entry]))
            total[r.place] += r.value << (LIMB * r.limb)
    made = [[list(entry) for entry in book] for book in codebooks]
    for (p, e), n in counts.items():
        made[p][e] = [x // n for x in totals.get((p, e), [0] * len(made[p][e]))]
    return made, whole


def distances(rows: np.ndarray, entries: list[list[int]]) -> np.ndarray:
    """Squared distance of every row to its entry."""
    most = int(abs(rows).max(initial=0)) + max({max(map(abs, e), default=0) for e in {tuple(e) for e in entries}}, default=0)
    if rows.dtype != object and rows.shape[1] * most**2 < SAFE:
        return squared(rows - np.array(entries, np.int64).reshape(rows.shape))
    return squared(rows.astype(object) - wide(entries, rows.shape))


def coded(held: DataFrame, codebooks: list[list[list[int]]], setting: CodeSetting, label: str) -> DataFrame:
    """vec_id, label, code and error of all rows of the blocks."""
    shared = held.sparkSession.sparkContext.broadcast(codebooks)

    def emit(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                codes, error = np.zeros((len(ids), setting.parts), np.uint8), np.zeros(len(ids), object)
                for p, tree in enumerate(trees_of(batch.column(2)[i].as_py(), setting.parts)):
                    entry, book = assign(tree, shared.value[p]).entry, shared.value[p]
                    codes[tree.order, p] = entry
                    error[tree.order] += distances(tree.rows, [book[e] for e in entry]).astype(object)
                error = [int(x) if x < 1 << 63 else None for x in error]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return held.mapInArrow(emit, f"vec_id long, label {label}, code string, error long")


def with_label_error(rows: DataFrame, salts: int = 16) -> DataFrame:
    """`rows` and the sum of error over equal labels; a label that many rows share is spread over `salts` keys."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.col("total").between(-(2**63), 2**63 - 1)
    sums = rows.groupBy(F.col("label").alias("_label")).agg(total.alias("total")).select("_label", F.when(fits, F.col("total").cast("long")).alias("label_error"))
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_mine", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_mine") == F.col("_salt"))
    return salted.join(sums, same, "left").drop("_label", "_salt", "_mine")


@dataclass
class Trained:
    """held: the blocks with their trees; codebooks by part; whole: parts assigned with a whole node, by round."""

    held: DataFrame | None
    codebooks: list[list[list[int]]]
    whole: list[int]


def train(rows: DataFrame, setting: CodeSetting = CodeSetting()) -> Trained:
    """Codebooks of `rows` (vec_id, v, label; vectors of one length)."""
    parts = setting.parts
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(setting.entries).collect()
    if not first:
        return Trained(None, [[] for _ in range(parts)], [])
    starts = whole_numbers(np.array([r.v for r in first], float), setting.scale)
    codebooks = [[[int(x) for x in row] for row in piece] for piece in np.split(starts, parts, axis=1)]
    held, whole = stored(blocks(rows, setting), "vector_trees"), []
    for _ in range(setting.rounds):
        codebooks, n = improved(held, codebooks, setting)
        whole.append(n)
    return Trained(held, codebooks, whole)


def digest(codebooks: list[list[list[int]]]) -> str:
    return sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, setting: CodeSetting = CodeSetting()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of `vectors` (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components go; other columns are not read. Codebooks start as
    the parts of the smallest vec_ids (equal ids by their vectors, null ids last); with fewer rows they have fewer entries.
    Repeated rows all count. The length of the vectors is that of the first row in this order whose length is a positive
    multiple of `parts`; rows of another length take no part and have a null code and error. An error or a sum of errors
    beyond a long is null. Without rows nothing returns.
    """
    rows, order = usable(vectors), [F.asc_nulls_last("vec_id"), "v"]
    cuttable = rows.where((F.size("v") > 0) & (F.size("v") % setting.parts == 0))
    one = cuttable.select("vec_id", "v").orderBy(*order).limit(1).collect()
    size = len(one[0].v) if one else -1
    trained = train(cuttable.where(F.size("v") == size), setting)
    label = rows.schema["label"].dataType.simpleString()
    others = rows.where(F.size("v") != size).selectExpr("vec_id", "label", "CAST(NULL AS string) AS code", "CAST(NULL AS bigint) AS error")
    codes = others
    if trained.held is not None:
        codes = stored(coded(trained.held, trained.codebooks, setting, label).unionByName(others), "vector_codes")
    out = with_label_error(codes).withColumn("codebooks_sha256", F.lit(digest(trained.codebooks)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
