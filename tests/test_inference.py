import math
import random

import numpy as np
import pytest

from riskloom.functions.stats import exact_mcnemar
from riskloom.operators import inference
from riskloom.operators.contracts import prediction_misalignment
from tests.test_metrics import SCHEMA, random_rows


def placements(scores, truth):
    pos = [s for s, y in zip(scores, truth) if y]
    neg = [s for s, y in zip(scores, truth) if not y]
    win = lambda p, n: (p > n) + 0.5 * (p == n)
    return (
        [sum(win(p, n) for n in neg) / len(neg) for p in pos],
        [sum(win(p, n) for p in pos) / len(pos) for n in neg],
    )


def variance(values):
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / (len(values) - 1)


def test_delong_matches_the_pairwise_definition(spark):
    rows = random_rows(120, 9)
    truth = [r[2] for r in rows if r[1] == "a"]
    pa, na = placements([r[4] for r in rows if r[1] == "a"], truth)
    pb, nb = placements([r[4] for r in rows if r[1] == "b"], truth)
    gap = sum(pa) / len(pa) - sum(pb) / len(pb)
    var = variance([x - y for x, y in zip(pa, pb)]) / len(pa) + variance([x - y for x, y in zip(na, nb)]) / len(na)
    r = inference.delong(spark.createDataFrame(rows, SCHEMA), ["a", "b"]).first()
    assert r["auc_diff"] == pytest.approx(gap) and r["z_score"] == pytest.approx(abs(gap) / math.sqrt(var))
    assert r["p_value_raw"] == pytest.approx(math.erfc(r["z_score"] / math.sqrt(2)))


def test_equal_models(spark):
    rows = [(i, m, i % 2, i % 2, float(i % 2)) for i in range(20) for m in ("a", "b", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    for r in inference.delong(df, ["a", "b", "c"]).collect():
        assert (r["z_score"], r["p_value_raw"], r["reject_bonferroni"]) == (0.0, 1.0, False)
    for r in inference.mcnemar(df, ["a", "b", "c"]).collect():
        assert (r["discordant_total"], r["p_value_raw"]) == (0, 1.0)


@pytest.mark.parametrize("b, c, p", [(0, 5, 0.0625), (1, 5, 0.21875), (3, 3, 1.0), (0, 1, 1.0)])
def test_exact_mcnemar(spark, b, c, p):
    rows = []
    for i in range(20):
        a_label = 0 if i < c else 1
        b_label = 0 if c <= i < c + b else 1
        rows += [(i, "a", 1, a_label, 0.5), (i, "b", 1, b_label, 0.5)]
    r = inference.mcnemar(spark.createDataFrame(rows, SCHEMA), ["a", "b"]).first()
    assert (r["a_correct_b_wrong"], r["a_wrong_b_correct"]) == (b, c)
    assert r["p_value_raw"] == pytest.approx(p)


def test_interval_holds_the_point(spark):
    df = spark.createDataFrame(random_rows(80, 6), SCHEMA)
    for r in inference.bootstrap_intervals(df, 40).collect():
        assert r["ci_lower"] - 0.05 <= r["point_estimate"] <= r["ci_upper"] + 0.05
    wide = inference.wide_intervals(inference.bootstrap_intervals(df, 10))
    assert {"auroc", "auroc_ci_lower", "auroc_with_ci"} <= set(wide.columns) and wide.count() == 2


def test_misaligned_rows_are_found(spark):
    rows = [r for r in random_rows(10, 1) if not (r[0] == 3 and r[1] == "b")]
    bad = prediction_misalignment(spark.createDataFrame(rows, SCHEMA), "row_index", "model_name", ["a", "b"]).collect()
    assert [r["row_index"] for r in bad] == [3]


@pytest.mark.parametrize("n", [10**6, 10**9, 10**12])
def test_exact_tails_of_many_pairs(spark, n):
    """Against adding up the tail from the greatest term down."""
    k = int(n / 2 - 0.9 * math.sqrt(n) / 2)
    a, b = k + 1.0, n - k
    first = math.exp(-(stirling(n) * -1 + stirling(k) + stirling(n - k)) - n * relative(k / n)) * math.sqrt(n / (2 * math.pi * k * (n - k)))
    steps = np.arange(int(9 * math.sqrt(n)))
    ratios = np.concatenate([[0.0], np.cumsum(np.log1p(-(n - 2.0 * k + 2 * steps[:-1] + 1) / (b + steps[:-1] + 1)))])
    tail = first * np.exp(ratios).sum()
    df = spark.createDataFrame([(k, n - k)], "b long, c long")
    assert a and df.select(exact_mcnemar("b", "c")).first()[0] == pytest.approx(2 * tail, abs=1e-6)


def stirling(n):
    return 1 / (12 * n) - 1 / (360 * n**3)


def relative(p):
    """Divergence of p from one half, by its series."""
    x = 2 * p - 1
    return sum(x ** (2 * j) / (2 * j * (2 * j - 1)) for j in range(1, 30))


def test_exact_tails_without_pairs(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (3, 3)], "b long, c long")
    assert [r[0] for r in df.select(exact_mcnemar("b", "c")).collect()] == [1.0, 1.0, 1.0]
