import json

import pytest
from pyspark.ml.classification import NaiveBayes

from riskloom.operators import learning, scoring
from riskloom.session import run_folder
from riskloom.sources.requests import parse_requests
from riskloom.streaming.scoring import model_score_requests


@pytest.fixture(scope="module")
def bundle(spark):
    rows = [(i % 2, "yes" if i % 3 else "no", float(i % 4 + i % 2), None) for i in range(40)]
    train = spark.createDataFrame(rows, "target_true int, dm string, su double, sod double")
    spec = learning.ModelSpec("counts", lambda: NaiveBayes(featuresCol=learning.VECTOR, labelCol="target_true"))
    path = run_folder(spark, "bundle")
    learning.save_bundle(learning.fit_bundle(train, spec, ["sod", "su"], ["dm"], "v7"), path)
    return learning.load_bundle(spark, path)


def test_stored_order_and_kinds(bundle):
    assert bundle.features == ("dm", "su", "sod") and set(bundle.numeric) == {"su", "sod"} and bundle.version == "v7"


def test_absent_fields_and_words_in_number_fields_are_missing(spark, bundle):
    df = spark.createDataFrame([("a", "2", "yes"), ("b", "many", "yes"), ("c", None, "yes")], "_score string, su string, dm string")
    rows = {r["_score"]: r["p"] for r in scoring.model_scores(df, scoring.fields(df), bundle, "p").collect()}
    assert rows["b"] == rows["c"] and rows["a"] != rows["b"] or rows["a"] == pytest.approx(rows["b"])
    assert all(0 < p < 1 for p in rows.values())


def test_an_unseen_word_is_scored(spark, bundle):
    df = spark.createDataFrame([("never", "1"), ("yes", "1")], "dm string, su string")
    assert scoring.model_scores(df, scoring.fields(df), bundle).count() == 2


def test_both_routes_and_refused_numbers(spark, bundle):
    bodies = [
        {"mode": "research", "inputs": {"su": 1, "dm": "yes", "sc": 2.2}},
        {"mode": "clinical", "inputs": {"dm": "Y", "scr": "2.5", "su": 4}},
        {"mode": "clinical", "inputs": {"dm": "Y", "scr": "high"}},
        {"inputs": {"sc": "abc"}},
        {"inputs": {"sc": "", "hemo": None, "wbcc": "n/a"}},
        {"inputs": {"scr": "abc"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    parsed = {r["i"]: (r["rejection"], r["rejected_field"]) for r in parse_requests(df, "body").collect()}
    assert parsed == {0: (None, None), 1: (None, None), 2: ("invalid_number", "scr"), 3: ("invalid_number", "sc"), 4: (None, None), 5: (None, None)}
    scored = {r["i"]: r for r in model_score_requests(df, "body", ["i"], bundle).collect()}
    assert set(scored) == {0, 1, 4, 5}
    assert scored[1]["model_version"] == "v7::clinical" and scored[0]["serving_route"] == "/predict/research"
    assert [e["feature"] for e in scored[0]["explanation"]] == ["sc", "dm"]
    # the clinical route takes no `su`, so it is scored as if it were missing
    table = spark.createDataFrame([("yes", None)], "dm string, su string")
    assert scored[1]["risk_score"] == pytest.approx(scoring.model_scores(table, scoring.fields(table), bundle).first()["_score"])


def test_batch_responses(spark, bundle):
    df = spark.createDataFrame([(1, "yes", "3", "4.0")], "k int, dm string, su string, scr string")
    research = scoring.model_responses(df, bundle, "research", ["k"]).first()
    clinical = scoring.model_responses(df, bundle, "clinical", ["k"]).first()
    assert research["serving_route"] == "/predict/research" and clinical["serving_route"] == "/predict/clinical"
    assert {e["feature"] for e in clinical["explanation"]} == {"scr", "dm"}


def test_rows_of_a_bundle_are_made_once(spark):
    """Fitting passes over its rows many times; what they are made from is worked out once per row."""
    made = spark.sparkContext.accumulator(0)

    def make(source):
        for batch in source:
            made.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(i % 2, float(i % 5), "ab"[i % 3 % 2]) for i in range(60)], "target_true int, x double, c string")
    spec = learning.ModelSpec("lr", learning.logistic_regression)
    bundle = learning.fit_bundle(rows.mapInPandas(make, rows.schema), spec, ["x"], ["c"], "v")
    assert bundle.features == ("x", "c") and made.value == 60
