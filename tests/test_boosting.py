import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import boosting as B


def table(spark, n=300, seed=1):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = draw.randrange(4), draw.random(), draw.choice([0.0, 1.0, float("nan")])
        y = int(draw.random() < (0.9 if (a > 1) != (b > 0.5) else 0.2))
        rows.append((float(a), b, c, y))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(
        spark.createDataFrame(rows, "a double, b double, c double, label int")
    )


def scores(model, df):
    return [r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()]


def test_one_task_and_one_aggregate_per_level_agree(spark):
    df = table(spark)
    cuts, trees = B.boost(df, "features", "label", B.BoostSetting(rounds=4, depth=3))
    same_cuts, spread = B.boost(df, "features", "label", B.BoostSetting(rounds=4, depth=3, held=0))
    assert cuts == same_cuts and len(trees) == 4
    for one, many in zip(trees, spread):
        assert one.feature.tolist() == many.feature.tolist() and one.upto.tolist() == many.upto.tolist()
        assert np.allclose(one.values, many.values)


def test_sums_leave_out_common_bins():
    """Sums of a table with one-hot features, and of nodes without a row in the common bin, as by plain counting."""
    draw = np.random.default_rng(4)
    bins = np.column_stack([draw.integers(0, 200, 500), *[1 + (draw.random(500) < share) for share in (0.1, 0.4, 0.0)]]).astype(np.uint8)
    node, values = draw.integers(0, 3, 500), draw.random(500)
    node[bins[:, 1] == 2] = 3  # node 3 has no row in that feature's common bin
    cells = B.Cells(bins)
    assert [rare is None for _, rare, _, _ in cells.features] == [True, False, False, False]
    out = B.sums(cells, node, 5, (values,))
    plain = np.zeros((5, 4, B.BINS + 1))
    for f in range(4):
        np.add.at(plain[:, f], (node, bins[:, f]), values)
    assert np.allclose(out[0], plain, atol=1e-12) and (out[0][plain == 0] == 0).all()


def test_distributed_rounds_need_a_pass_per_level(spark):
    """More rounds than are kept between two written scores; jobs are a pass per level, and leaves need none."""
    df, setting = table(spark), B.BoostSetting(rounds=B.KEPT + 3, depth=2)
    cuts, trees = B.boost(df, "features", "label", setting)
    cells = B.cells_of(df, "features", "label", cuts).persist()
    cells.count()
    spark.sparkContext.setJobGroup("rounds", "")
    spread = B.grow_over(cells, 3, setting)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2 * setting.rounds + 12
    for one, many in zip(trees, spread):
        assert one.feature.tolist() == many.feature.tolist() and one.upto.tolist() == many.upto.tolist() and np.allclose(one.values, many.values)


def test_splits_by_trying_all(spark):
    """The first split has the greatest gain of all (feature, value) pairs."""
    df = table(spark)
    cuts, trees = B.boost(df, "features", "label", B.BoostSetting(rounds=1, depth=1, step=1.0))
    rows = [(*r["features"].toArray(), r["label"]) for r in df.select("features", "label").collect()]
    best = (0.0, None)
    for f in range(3):
        for v in sorted({r[f] for r in rows if r[f] == r[f]} | {-1.0}):
            left = [r for r in rows if not r[f] > v]
            right = [r for r in rows if r[f] > v]
            g = [sum(r[3] - 0.5 for r in side) for side in (left, right)]
            h = [len(side) / 4 for side in (left, right)]
            if min(h) >= 1:
                gain = sum(x * x / (y + 1) for x, y in zip(g, h)) - sum(g) ** 2 / (sum(h) + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, g[0] / (h[0] + 1), g[1] / (h[1] + 1))
    assert trees[0].values.tolist() == pytest.approx(list(best[1:]))


def test_learns_an_interaction_and_survives_a_restart(spark, tmp_path):
    train, test = table(spark), table(spark, 200, 2)
    model = B.HistogramBoosting(B.BoostSetting(rounds=60), labelCol="label").fit(train)
    hits = model.transform(test).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert hits > 0.78
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    assert scores(PipelineModel.load(str(tmp_path / "m")), test) == scores(model, test)


def test_a_separable_feature_one_class_and_no_rows(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(float(i), int(i >= 30)) for i in range(60)], "x double, label int"))
    model = B.HistogramBoosting(B.BoostSetting(rounds=300)).fit(df)
    found = scores(model, df.orderBy("x"))
    assert max(found[:30]) < 0.05 and min(found[30:]) > 0.95
    assert min(scores(B.HistogramBoosting(B.BoostSetting(rounds=20)).fit(df.where("label = 1")), df)) > 0.6
    assert scores(B.HistogramBoosting().fit(df.where("x < 0")), df) == [0.5] * 60
