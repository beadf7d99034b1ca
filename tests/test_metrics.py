import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators import ranking
from riskloom.operators.monitor import exact_quantiles

SCHEMA = "row_index long, model_name string, target_true int, prediction_label int, risk_score double"


def random_rows(n, seed=1, hot=0.4):
    """Two models; many rows of the first share one score."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.35)
        for m in ("a", "b"):
            s = 0.5 if m == "a" and rng.random() < hot else round(rng.random() * 0.7 + 0.3 * y, 2)
            rows.append((i, m, y, int(s >= 0.5), s))
    return rows


def brute(rows):
    pos = [r[4] for r in rows if r[2] == 1]
    neg = [r[4] for r in rows if r[2] == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in sorted(set(pos)):
        tp = sum(p >= s for p in pos)
        ap += pos.count(s) / len(pos) * tp / (tp + sum(n >= s for n in neg))
    brier = sum((r[4] - r[2]) ** 2 for r in rows) / len(rows)
    return auc, ap, brier


def test_metrics_match_brute_force_with_a_hot_score(spark):
    rows = random_rows(300)
    df = spark.createDataFrame(rows, SCHEMA)
    for r in M.metric_table(df, ["model_name"]).collect():
        auc, ap, brier = brute([x for x in rows if x[1] == r["model_name"]])
        assert r["auroc"] == pytest.approx(auc) and r["auprc"] == pytest.approx(ap)
        assert r["brier_score"] == pytest.approx(brier)


def test_auroc_of_negated_scores(spark):
    df = spark.createDataFrame(random_rows(200, 5), SCHEMA)
    up = {r["model_name"]: r["auroc"] for r in M.auroc(df, ["model_name"]).collect()}
    down = M.auroc(df.withColumn("risk_score", -F.col("risk_score")), ["model_name"]).collect()
    assert all(up[r["model_name"]] + r["auroc"] == pytest.approx(1.0) for r in down)


def test_empty_denominators(spark):
    df = spark.createDataFrame([(1, "a", 1, 0, 0.2), (2, "a", 1, 0, 0.3)], SCHEMA)
    r = M.metric_table(df, ["model_name"]).first()
    assert (r["precision"], r["recall_sensitivity"], r["f1_score"], r["specificity"], r["auroc"]) == (0.0, 0.0, 0.0, None, None)


def test_calibration_bins_are_left_open(spark):
    df = spark.createDataFrame([(i, "a", 1, 1, s) for i, s in enumerate((0.0, 0.1, 0.3, 0.31, 1.0))], SCHEMA)
    assert sorted((r["bin"], r["row_count"]) for r in M.calibration(df, ["model_name"]).collect()) == [(0, 2), (2, 1), (3, 1), (9, 1)]


def test_fold_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "model_name string, auroc double")
    rows = {r["model_name"]: r for r in M.fold_summary(df, ["model_name"], ["auroc"]).collect()}
    assert rows["a"]["auroc_mean"] == 2.0 and rows["a"]["auroc_std"] == pytest.approx(math.sqrt(2))
    assert rows["b"]["auroc_std"] == 0.0


def test_running_totals_do_not_depend_on_the_ranges(spark):
    rng = random.Random(2)
    data = {(g, v): rng.randint(1, 5) for g in "xy" for v in rng.sample(range(1000), 120)}
    df = spark.createDataFrame([(g, float(v), n) for (g, v), n in data.items()], "g string, v double, n long")
    for cuts in ([], [500.0], ranking.range_cuts(df, "v", 50)):
        for r in ranking.running_totals(df, ["g"], "v", ["n"], cuts).collect():
            assert r["before_n"] == sum(n for (g, v), n in data.items() if g == r["g"] and v < r["v"])
            assert r["total_n"] == sum(n for (g, _), n in data.items() if g == r["g"])


def test_running_last_across_ranges(spark):
    rows = [(t, f"m{t}" if t % 7 == 0 else None) for t in range(60)]
    df = spark.createDataFrame([(t, t, v) for t, v in rows], "t long, id long, v string")
    got = ranking.running_last(df, [], ["t", "id"], "v", "before", [10.0, 25.0, 26.0, 50.0]).collect()
    for r in got:
        earlier = [v for t, v in rows if t < r["t"] and v is not None]
        assert r["before"] == (earlier[-1] if earlier else None)


def test_exact_quantiles(spark):
    values = [3.0, 1.0, 2.0, 10.0, 10.0, 4.5]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("b", None)], "g string, v double")
    rows = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert rows["a"]["p50"] == 3.75 and rows["a"]["p95"] == 10.0 and rows["b"]["p95"] == 7.0


def test_best_takes_the_first_listed_on_a_tie(spark):
    df = spark.createDataFrame([("a", 0, 0.9), ("b", 1, 0.9)], "model_name string, model_order int, auroc_mean double")
    assert M.best_by(df, [F.desc("auroc_mean"), F.asc("model_order")]).first()["model_name"] == "a"
