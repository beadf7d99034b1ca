"""Exact top-k by inner product: a Voronoi join.

With one component more, sqrt(M^2 - |x|^2) for data (M the largest norm) and 0 for queries, the largest inner product is
the smallest Euclidean distance. Queries and data go to the cells of their nearest pivots. Summaries of the cells (radius
of the queries, smallest distances of the data) bound how far the k-th neighbour of any query of a cell can be. A data
row is copied to the groups of queries whose bound it can meet, and each group is solved in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import batches, fewest, stored
from riskloom.session import shuffle_partitions


@dataclass(frozen=True)
class KnnSetting:
    """k: neighbours; pivots: most pivots; queries, rows: most queries and about how many data rows in one block."""

    k: int = 20
    pivots: int = 512
    queries: int = 512
    rows: int = 8192


def whole_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component x. Rows without an id, a vector or a finite component drop out.

    vec_id is a key: a repeated row counts once, and of several vectors of one id the smallest, by components, counts.
    """
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    valid = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    whole = valid.select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    return whole.groupBy("vec_id").agg(F.min("v").alias("v"))


class Space:
    """The space with one component more; what it needs is a few numbers and the pivots."""

    def __init__(self, width: int, most: int, norm: float) -> None:
        self.width, self.norm = width, float(norm)
        self.kind = np.dtype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8")
        self.exact = max(most, 1) ** 2 * max(width, 1) < 2**53  # sums of products are exact as doubles
        self.pivots = np.zeros((0, width + 1))

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Rows of a list column; shorter vectors end in zeros."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(column), self.width), np.int64)
        out[np.arange(self.width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def lifted(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        rest = np.sqrt(np.maximum(self.norm - (rows * rows).sum(1), 0.0))
        return np.column_stack([rows, np.where(query, 0.0, rest)])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot."""
        squares = (self.pivots**2).sum(1)
        cell = (squares - 2 * points @ self.pivots.T).argmin(1)
        return cell, np.sqrt(((points - self.pivots[cell]) ** 2).sum(1))


class Bounds:
    """Which distances to its pivot make a data row needed by which group of queries."""

    def __init__(self, space: Space, query_cells, nearest, setting: KnnSetting) -> None:
        count = {r["cell"]: r["n"] for r in query_cells}
        self.cells = np.array(sorted(count), np.int64)  # cells with queries
        radius = np.array([r["far"] for r in sorted(query_cells, key=lambda r: r["cell"])])
        apart = np.sqrt(((space.pivots[self.cells, None, :] - space.pivots[None, :, :]) ** 2).sum(2))
        held = np.array([(r["cell"], r["dist"]) for r in nearest]).reshape(-1, 2)
        where, dist = held[:, 0].astype(np.int64), held[:, 1]
        theta = np.full(len(self.cells), np.inf)
        if len(where) > setting.k:  # a query is no neighbour of itself: one more
            theta = np.partition(radius[:, None] + apart[:, where] + dist, setting.k, axis=1)[:, setting.k]
        slack = 1e-6 * (1 + np.sqrt(space.norm))
        self.low = apart - (radius + theta)[:, None] - slack
        self.high = apart + (radius + theta)[:, None] + slack
        self.first, self.parts, self.groups = self._grouped(count, apart, setting.queries)

    def _grouped(self, count, apart, most: int):
        """Near cells share a group of at most `most` queries; a larger cell is dealt over several groups."""
        first, parts = np.full(len(self.cells), -1), np.ones(len(self.cells), np.int64)
        group = 0
        for i in np.argsort([-count[c] for c in self.cells], kind="stable"):
            if first[i] >= 0:
                continue
            own = count[self.cells[i]]
            first[i], parts[i] = group, -(-own // most)
            if own < most:
                for j in np.argsort(apart[i][self.cells], kind="stable"):
                    if first[j] < 0 and own + count[self.cells[j]] <= most:
                        first[j], own = group, own + count[self.cells[j]]
            group += int(parts[i])
        return first, parts, group

    def needed(self, cell: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of each copy that data rows of `cell` at `dist` need."""
        row, at = np.nonzero((dist[:, None] >= self.low[:, cell].T) & (dist[:, None] <= self.high[:, cell].T))
        rows, groups = np.repeat(row, self.parts[at]), np.repeat(self.first[at], self.parts[at])
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(self.parts[at]) - self.parts[at], self.parts[at])
        pairs = np.unique(np.column_stack([rows, groups + inner]), axis=0)
        return pairs[:, 0], pairs[:, 1]


def top(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
    """(query, vec_id, score) of the k best rows of `data` for each query; ties go to the smaller id."""
    order = np.argsort(data_ids, kind="stable")
    data, data_ids = data[order], data_ids[order]
    scores = queries @ data.T
    out = []
    for query_id, row in zip(query_ids, scores):
        usable = np.flatnonzero(data_ids != query_id)
        row = row[usable]
        if len(row) > k:
            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            usable, row = usable[near], row[near]
        best = np.argsort(-row, kind="stable")[:k]
        out.append((np.full(len(best), query_id), data_ids[usable[best]], row[best].astype(np.int64)))
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def search(vectors: DataFrame, setting: KnnSetting = KnnSetting()) -> DataFrame:
    """The k rows of largest inner product for every query among all other rows.

    `vectors` holds vec_id, v (whole numbers) and is_query, one row per vec_id. Returns query_id, rank from 1, vec_id and
    score. Ties go to the smaller vec_id; with fewer other rows than k all are returned. Missing components of shorter
    vectors count as 0. Scores must fit a long. Equal vectors keep their rows. Without queries or rows nothing returns.
    """
    spark, k = vectors.sparkSession, setting.k
    result = "query_id long, rank int, vec_id long, score long"
    vectors = stored(vectors.select("vec_id", "v", "is_query"), "vectors")
    size = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))  # squares may pass a long
    facts = vectors.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("queries"), F.max(F.size("v")).alias("width"),
        F.max(F.array_max(F.transform("v", lambda e: F.abs(e.cast("double"))))).alias("most"), F.max(size).alias("norm"),
    ).first()
    if not facts["queries"]:
        return spark.createDataFrame([], result)
    space = Space(facts["width"], int(facts["most"] or 0), facts["norm"] or 0)
    wanted = int(min(setting.pivots, max(8, facts["n"] ** 0.5)))
    some = fewest(vectors, wanted, F.col("vec_id"), "vec_id").select("v").toArrow().column(0)
    points = np.unique(space.matrix(some), axis=0)
    space.pivots = space.lifted(points, np.zeros(len(points), bool))

    def assign(batch: pa.RecordBatch) -> pa.Table:
        rows, query = space.matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        packed = np.array([r.tobytes() for r in rows.astype(space.kind)] or [b""], object)[: len(rows)]
        parts = []
        for side in (False, True):  # a query is a data row for the others
            chosen = np.flatnonzero(query) if side else np.arange(len(rows))
            cell, dist = space.nearest(space.lifted(rows[chosen], np.full(len(chosen), side)))
            parts.append(
                pa.table({"vec_id": batch.column(0).take(pa.array(chosen)), "is_query": pa.array(np.full(len(chosen), side)),
                          "cell": pa.array(cell, pa.int32()), "dist": pa.array(dist), "v": pa.array(packed[chosen], pa.binary())})
            )
        return pa.concat_tables(parts)

    assigned = batches(vectors.select("vec_id", "v", "is_query"), assign, "vec_id long, is_query boolean, cell int, dist double, v binary")
    assigned = stored(assigned, "cells")
    cells = assigned.where("is_query").groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()
    by_dist = Window.partitionBy("cell").orderBy("dist")
    nearest = assigned.where("NOT is_query").select("cell", "dist", F.row_number().over(by_dist).alias("r")).where(F.col("r") <= k + 1)
    bounds = Bounds(space, cells, nearest.collect(), setting)
    shards = max(-(-facts["n"] // setting.rows), min(-(-facts["n"] // 512), 2 * shuffle_partitions(spark) // bounds.groups))
    place_of = {int(c): i for i, c in enumerate(bounds.cells)}

    def deal(batch: pa.RecordBatch) -> pa.Table:
        """A row for each block a row belongs to: a query to all shards of its group, data to its shard of each group."""
        cell, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        query, mixed = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(5).to_numpy()
        data = np.flatnonzero(~query)
        row, group = bounds.needed(cell[data], dist[data])
        rows, blocks = [data[row]], [group * shards + mixed[data[row]] % shards]
        asked = np.flatnonzero(query)
        if len(asked):
            at = np.array([place_of[int(c)] for c in cell[asked]])
            group = bounds.first[at] + mixed[asked] % bounds.parts[at]
            rows.append(np.repeat(asked, shards))
            blocks.append((group[:, None] * shards + np.arange(shards)).ravel())
        rows, blocks = np.concatenate(rows), np.concatenate(blocks)
        kept = batch.select(["vec_id", "is_query", "v"]).take(pa.array(rows))
        return pa.table({"block": pa.array(blocks, pa.int64()), **{n: kept.column(n) for n in kept.schema.names}})

    mixed = assigned.withColumn("mixed", F.pmod(F.xxhash64("vec_id"), F.lit(2**31)))
    dealt = batches(mixed, deal, "block long, vec_id long, is_query boolean, v binary")

    def solve(block: pa.Table) -> pa.Table:
        ids = block.column("vec_id").to_numpy()
        query = block.column("is_query").to_numpy().astype(bool)
        rows = np.frombuffer(b"".join(block.column("v").to_pylist()), space.kind).reshape(len(ids), space.width)
        rows = rows.astype(np.float64 if space.exact else np.int64)
        found = top(rows[query], ids[query], rows[~query], ids[~query], k)
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), found)})

    found = dealt.groupBy("block").applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
