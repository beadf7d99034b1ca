import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import binomial
from riskloom.functions.binomial import binomial_cdf, binomial_quantile
from riskloom.operators import bootstrap
from riskloom.operators.metrics import metric_table
from tests.test_metrics import SCHEMA, random_rows


@pytest.mark.parametrize("n", [1, 7, 256, 257, 4000, 20_000])
@pytest.mark.parametrize("p", [1e-6, 0.02, 0.5, 0.77, 0.999])
def test_quantiles_by_adding_up(n, p):
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p) for k in range(n + 1)]
    cdf = np.cumsum(np.exp(logs))
    u = np.random.default_rng(n).random(300)
    expected = np.minimum(np.searchsorted(cdf, u), n)
    assert np.array_equal(binomial_quantile(u, np.full(300, n), p), expected)
    assert np.allclose(binomial_cdf(expected, n, p), cdf[expected], atol=1e-9)


def test_quantiles_at_the_ends():
    assert binomial_quantile(np.array([0.3, 0.3, 0.3]), np.array([0, 9, 9]), np.array([0.5, 0.0, 1.0])).tolist() == [0, 0, 9]
    far = binomial_quantile(np.linspace(0.001, 0.999, 500), np.full(500, 10**12), 0.3)
    assert abs(far.mean() - 3e11) < 1e5 and (np.diff(far) >= 0).all()


def test_probabilities_on_both_ways():
    """The integral and the fraction agree from the counts on where one takes over."""
    for n in (2 * binomial.MANY + 10, 500, 5000):
        k = np.arange(binomial.MANY + 1, n - binomial.MANY - 1).astype(float)
        for p in (0.1, 0.5, 0.8):
            near = k[np.abs(k - n * p) < 8 * math.sqrt(n * p * (1 - p))]
            sizes, shares = np.full(len(near), float(n)), np.full(len(near), p)
            assert np.allclose(binomial.by_quadrature(near, sizes, shares), binomial.by_fraction(near, sizes, shares), rtol=0, atol=1e-11)


def test_small_tables_are_drawn_in_many_tasks(spark):
    """Cells are few bytes, which adaptive execution would put into one task for all replicates."""
    df = spark.createDataFrame(random_rows(60, 4), SCHEMA)
    drawn = bootstrap.bootstrap_metrics(df, 100, block=16, chunk=10)
    drawn.collect()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("FlatMapGroupsInPandas")[1] and "coalesced" not in plan.split("FlatMapGroupsInPandas")[1].split("REPARTITION_BY_NUM")[0]


def test_draws_of_a_tree_keep_sizes_and_shares():
    weights = np.array([5, 0, 1, 94, 0, 300, 0, 0])
    keys = bootstrap.replicate_keys(1, "m", 1, range(1, 4001))
    drawn = bootstrap.leaf_draws(weights, np.full(4000, 400), keys, 1)
    assert (drawn.sum(1) == 400).all() and (drawn[:, weights == 0] == 0).all()
    assert np.allclose(drawn.mean(0), weights, atol=0.5)
    p = weights / 400
    assert np.allclose(drawn.var(0), 400 * p * (1 - p), rtol=0.1, atol=0.01)
    covariance = np.cov(drawn[:, 3], drawn[:, 5])[0, 1]
    assert covariance == pytest.approx(-400 * p[3] * p[5], rel=0.1)


@pytest.mark.parametrize("size", [4, 16])
def test_blocks_draw_what_one_task_draws(spark, size):
    df = spark.createDataFrame(random_rows(60, 4), SCHEMA)
    whole = {(r["model_name"], r["replicate"]): r for r in bootstrap.bootstrap_metrics(df, 12).collect()}
    for r in bootstrap.bootstrap_metrics(df, 12, block=size, chunk=5).collect():
        assert [round(x, 9) for x in r[3:]] == [round(x, 9) for x in whole[r["model_name"], r["replicate"]][3:]]
    assert len(whole) == 24


def test_mean_of_replicates_is_near_the_point(spark):
    df = spark.createDataFrame(random_rows(300, 6), SCHEMA)
    point = {r["model_name"]: r for r in metric_table(df, ["model_name"]).collect()}
    means = bootstrap.bootstrap_metrics(df, 400).groupBy("model_name").agg(*[F.avg(m).alias(m) for m in ("auroc", "accuracy", "brier_score")])
    for r in means.collect():
        assert all(abs(r[m] - point[r["model_name"]][m]) < 0.02 for m in ("auroc", "accuracy", "brier_score"))


def test_one_class_and_no_rows(spark):
    one = spark.createDataFrame([r for r in random_rows(20, 3) if r[2] == 1], SCHEMA)
    assert all(r["auroc"] is None and r["n_negative"] == 0 for r in bootstrap.bootstrap_metrics(one, 3).collect())
    assert bootstrap.bootstrap_metrics(spark.createDataFrame([], SCHEMA), 3).count() == 0
