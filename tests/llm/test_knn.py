import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import voronoi_knn
from riskloom.llm.common import table
from tests.llm.cases import FOLDER

SCHEMA = "vec_id long, embedding array<double>, is_query string, score double"


def plain(rows, k=20):
    """(query, rank, vec_id, score) by comparing all rows."""
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            whole[i] = min(whole.get(i, w), w)
    out = []
    for q in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def searched(spark, rows, setting=voronoi_knn.KnnSetting()):
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], SCHEMA).repartition(3)
    vectors = voronoi_knn.whole_vectors(df).withColumn("is_query", F.col("vec_id") % 20 == 0)
    return sorted(tuple(r) for r in voronoi_knn.search(vectors, setting).collect())


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clustered_vectors(spark, spread):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + spread * draw.normal(size=8)).tolist()) for i in range(400)]
    assert searched(spark, rows, voronoi_knn.KnnSetting(queries=4, rows=64)) == plain(rows)


def test_large_components(spark):
    """Squares of components may pass a long, as long as the scores don't."""
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(60)]
    rows[7] = (7, [1e9, 0.0, 0.0, 0.0])
    rows[20] = (20, [3.0, -1e9, 0.5, 0.0])
    assert searched(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [0.0, 9.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [2.0]), (40, [-1.0, -1.0])]
    assert searched(spark, rows) == plain(rows)
    assert searched(spark, rows[:1]) == [] and searched(spark, []) == [] and searched(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_query_over_the_table(spark):
    from riskloom.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    assert sorted(tuple(r) for r in QUERIES["op1_voronoi_knn"](spark, FOLDER).collect()) == plain(rows)
