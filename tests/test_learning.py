import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import learning as L
from riskloom.operators import leakage, split
from riskloom.plans.evaluate import evaluate, significance


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        y = int(rng.random() < 0.4)
        x = y * 1.5 + rng.gauss(0, 1)
        rows.append((i, x if i % 9 else None, 2 * x + rng.gauss(0, 0.1) if i % 7 else None, rng.random(), "ab"[rng.random() < 0.3 + 0.4 * y] if i % 8 else None, y))
    return spark.createDataFrame(rows, "k long, x double, z double, noise double, c string, target_true int").persist()


def test_medians_and_modes(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "b"), (8.0, "a"), (None, None)], "x double, c string")
    assert L.medians(df, ["x"]) == {"x": 3.0} and L.modes(df, ["c"]) == {"c": "a"}


def test_chained_imputation_uses_the_other_column(data):
    stages = L.fill_by_regression(data, ["x", "z"], rounds=2)
    out = data
    for stage in stages:
        out = stage.transform(out)
    assert set(out.columns) == set(data.columns) and out.filter("x is null or z is null").count() == 0
    filled = out.join(data.filter("z is null and x is not null").select("k"), "k")
    assert filled.filter(F.abs(F.col("z") - 2 * F.col("x")) > 1.0).count() == 0


def test_model_takes_unseen_categories_and_survives_a_restart(data, tmp_path):
    spec = L.ModelSpec("lr", L.logistic_regression, "ice", "standard", "cleanup")
    model = L.fit(data, spec, ["x", "z", "noise"], ["c"])
    fresh = data.withColumn("c", F.lit("never seen"))
    first = L.predict(model, fresh, "k", "lr")
    L.save(model, str(tmp_path / "model"))
    again = L.predict(L.load(str(tmp_path / "model")), fresh, "k", "lr")
    assert first.count() == 160 and sorted(first.collect()) == sorted(again.collect())


def test_search_respects_the_threshold(data):
    folded = split.stratified_folds(data, "k", "target_true", 2)
    space = L.SearchSpace({"lr": L.logistic_regression}, imputers=("median",), score_threshold=0.999)
    none = L.search(folded, space, ["x", "noise"], [], "k", 2)
    assert len(none.trials) == 1 and none.members == []
    space.score_threshold = 0.5
    some = L.search(folded, space, ["x", "noise"], [], "k", 2)
    assert [round(w, 6) for w, _ in some.members] == [1.0]
    assert L.predict_ensemble(some.members, data, "k", "e").filter("risk_score between 0 and 1").count() == 160


def test_halving_tries_all_and_keeps_few(data):
    folded = split.stratified_folds(data, "k", "target_true", 3)
    drawn = L.Drawn(lambda penalty: lambda: L.logistic_regression(penalty), {"penalty": [1e-4, 0.1, 10.0]})
    space = L.SearchSpace({"lr": drawn, "boost": L.gradient_boosting(5)}, imputers=("median", "ice"), score_threshold=0.5, ensemble_size=2)
    names = [s.name for s in L.candidates(space, 8)]
    assert len(names) == len(set(names)) and 4 < len(names) <= 8 and names == [s.name for s in L.candidates(space, 8)]
    found = L.search(folded, space, ["x", "noise"], [], "k", 3, draws=8, keep=2)
    assert sorted(n for n, _ in found.trials) == sorted(names) and all(0 <= s <= 1 for _, s in found.trials)
    assert 1 <= len(found.members) <= 2 and sum(w for w, _ in found.members) == pytest.approx(1.0)


def test_greedy_weights(spark):
    """b alone ranks best, and a mean with c ranks better still; a is noise."""
    rng, rows = random.Random(2), []
    for i in range(200):
        y = i % 2
        left, right = rng.gauss(0, 1), rng.gauss(0, 1)
        rows += [(i, m, y, 0, s) for m, s in (("a", rng.random()), ("b", 0.5 + 0.1 * (y + left)), ("c", 0.5 + 0.1 * (y - left + 0.3 * right)))]
    df = spark.createDataFrame(rows, "row_index long, model_name string, target_true int, prediction_label int, risk_score double")
    weights = L.ensemble_weights(df, ["a", "b", "c"], 3)
    assert weights.get("a", 0) < 0.15 and 0.3 < weights["b"] < 0.7 and sum(weights.values()) == pytest.approx(1)
    assert set(L.ensemble_weights(df, ["a", "b", "c"], 1)) == {"a"} and len(L.ensemble_weights(df, ["a", "b", "c"], 2)) == 2


PREDICTIONS = "row_index long, model_name string, target_true int, prediction_label int, risk_score double"


def prediction_rows(spark, truths, **scores):
    """Predictions of some models; a score that is None leaves the row out."""
    rows = [(i, m, y, 0, s) for m, found in scores.items() for i, (y, s) in enumerate(zip(truths, found)) if s is not None]
    return spark.createDataFrame(rows, PREDICTIONS)


def area(truths, scores, counts):
    """Share of won pairs by the mean of the scores that are there; a pair of a row without one is half won."""
    means = []
    for at in range(len(truths)):
        there = [(n, s[at]) for n, s in zip(counts, scores) if n and s[at] is not None]
        means.append(sum(n * s for n, s in there) / sum(n for n, _ in there) if there else None)
    pairs = [(p, q) for p, y in zip(means, truths) if y for q, z in zip(means, truths) if not z]
    return sum(0.5 if p is None or q is None or p == q else float(p > q) for p, q in pairs) / len(pairs)


def test_greedy_weights_go_through_all_rounds(spark):
    """Round two gains nothing - b as half of the mean ranks worse - but b as a third ranks all pairs."""
    truths, a, b = [1, 1, 1, 0, 0, 0], [0.8, 0.5, 0.6, 0.4, 0.5, 0.4], [0.1, 0.7, 0.6, 0.7, 0.4, 0.5]
    assert [round(9 * area(truths, [a, b], n), 1) for n in ([1, 0], [1, 1], [2, 1])] == [8.5, 7, 9]
    df = prediction_rows(spark, truths, a=a, b=b)
    assert L.ensemble_weights(df, ["a", "b"], 2, rounds=2) == {"a": 1.0}
    assert L.ensemble_weights(df, ["a", "b"], 2, rounds=4) == pytest.approx({"a": 2 / 3, "b": 1 / 3})


def test_greedy_weights_by_all_pairs(spark):
    """Six rounds over three models, which did not score all rows, by all pairs of rows."""
    rng = random.Random(7)
    truths = [int(rng.random() < 0.5) for _ in range(40)]
    scores = [[0.5 + 0.1 * y + rng.gauss(0, 0.12) if rng.random() < 0.8 else None for y in truths] for _ in range(3)]
    picked, best, chosen = [0, 0, 0], -1.0, None
    for _ in range(6):
        areas = [round(area(truths, scores, [n + (i == j) for j, n in enumerate(picked)]), 9) for i in range(3)]
        picked[areas.index(max(areas))] += 1
        if max(areas) > best:
            best, chosen = max(areas), {m: n / sum(picked) for m, n in zip("abc", picked) if n}
    found = L.ensemble_weights(prediction_rows(spark, truths, **dict(zip("abc", scores))), ["a", "b", "c"], 3, rounds=6)
    assert found == pytest.approx(chosen) and len(found) > 1


def test_greedy_weights_count_all_rows(spark):
    """Rows that b did not score, and both copies of a row, decide as well; one class alone decides nothing."""
    df = prediction_rows(spark, [1, 0, 1, 0, 1, 0], a=[0.5, 0.1, 0.2, 0.8, 0.3, 0.7], b=[0.6, 0.4, None, None, None, None])
    assert L.ensemble_weights(df, ["a", "b"], 2, rounds=1) == {"b": 1.0}
    copies = {"a": [(0, 1, 0.6), (1, 0, 0.5), (2, 1, 0.4), (2, 1, 0.4)], "b": [(0, 1, 0.4), (1, 0, 0.5), (2, 1, 0.6), (2, 1, 0.6)]}
    df = spark.createDataFrame([(i, m, y, 0, s) for m, rows in copies.items() for i, y, s in rows], PREDICTIONS)
    assert L.ensemble_weights(df, ["a", "b"], 2, rounds=1) == {"b": 1.0}
    alone = prediction_rows(spark, [1, 1], a=[0.1, 0.2], b=[0.3, 0.4])
    assert L.ensemble_weights(alone, ["a", "b"], 2) == {"a": 1.0}


def test_evaluate_and_significance(data):
    specs = [L.ModelSpec("lr", L.logistic_regression), L.ModelSpec("rf", L.random_forest(5))]
    out = evaluate(data, "k", "target_true", specs, folds=2)
    assert out.best.first()["model_name"] in ("lr", "rf")
    assert {r["model_name"]: r["n_rows"] for r in out.test_metrics.collect()} == {"lr": 32, "rf": 32}
    tables = significance(out.predictions, ["lr", "rf"], replicates=10)
    assert tables["delong"].count() == 1 and tables["mcnemar"].count() == 1 and tables["wide_intervals"].count() == 2


def test_leakage_screen(data):
    parts = split.stratified_split(data.withColumn("leak", F.col("target_true") * 2.0), "k", "target_true")
    screen = leakage.feature_screen(parts, "target_true", skip=["k"]).collect()
    assert screen[0]["feature_name"] == "leak" and screen[0]["leakage_risk_level"] == "review"
    assert leakage.top_features(leakage.feature_screen(parts, "target_true", skip=["k"]), 2).count() == 2


def test_chained_imputation_by_plain_regressions(spark):
    """All guesses of three columns after two rounds, by least squares over the filled table."""
    import numpy as np

    rng = np.random.default_rng(3)
    full = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.7], [0, 0, 1]]) + [5, -3, 100]
    gaps = rng.random(full.shape) < 0.25
    rows = [(i, *[None if g else float(v) for v, g in zip(r, m)]) for i, (r, m) in enumerate(zip(full, gaps))]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    work = np.where(gaps, np.nan, full)
    work = np.where(gaps, np.nanmean(work, axis=0), work)
    for _ in range(2):
        for c in range(3):
            x = np.column_stack([np.ones(200), np.delete(work, c, axis=1)])
            w = np.linalg.lstsq(x[~gaps[:, c]], work[~gaps[:, c], c], rcond=None)[0]
            work[gaps[:, c], c] = x[gaps[:, c]] @ w
    out = df
    for stage in L.fill_by_regression(df, ["a", "b", "c"], rounds=2):
        out = stage.transform(out)
    found = np.array([r[1:] for r in out.orderBy("k").collect()])
    assert np.allclose(found, work, rtol=1e-9, atol=1e-9)


def test_chained_imputation_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (3.0, None, 2.0), (None, None, None)], "a double, b double, c double")
    for stage in L.fill_by_regression(df, ["a", "b", "c"], rounds=2):
        df = stage.transform(df)
    assert [tuple(round(x, 6) for x in r) for r in df.collect()] == [(1.0, 0.0, 2.0), (3.0, 0.0, 2.0), (2.0, 0.0, 2.0)]
