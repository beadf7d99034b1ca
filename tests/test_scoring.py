import base64
import json

import pytest
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.operators import scoring
from riskloom.sources.requests import parse_requests
from riskloom.streaming.scoring import score_requests


def inputs(spark, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, inputs map<string,string>")
    return df, scoring.map_fields("inputs")


def items(spark, row, make):
    df, field = inputs(spark, row)
    return [(r["feature"], r["contribution"]) for r in df.select(F.inline(make(field))).collect()]


def test_contributions_are_ranked_and_zero_terms_dropped(spark):
    found = items(spark, {"sc": "3.2", "hemo": "12.5", "al": "1", "htn": "yes", "pe": "Y", "dm": "no"}, scoring.research_contributions)
    assert found == [("sc", 0.18), ("htn", 0.08), ("pe", 0.06), ("al", 0.04)]


def test_at_most_six_and_stable_ties(spark):
    row = {"htn": "yes", "dm": "yes", "cad": "yes", "ane": "yes", "pe": "yes", "appet": "poor", "al": "2"}
    assert [f for f, _ in items(spark, row, scoring.research_contributions)] == ["al", "htn", "dm", "ane", "pe", "cad"]


def test_poor_appetite_counts(spark):
    """The raw word is compared, so the term can fire."""
    assert items(spark, {"appet": "Poor"}, scoring.research_contributions) == [("appet", 0.05)]


def test_fallback_item(spark):
    assert items(spark, {"sc": "n/a"}, scoring.research_contributions) == [("intake", 0.02)]
    assert items(spark, {}, scoring.clinical_contributions) == [("intake", 0.02)]


def test_scorecards(spark):
    df, field = inputs(spark, {"age": "60", "dm": "yes", "scr": "2", "egfr": "30"}, {"sg": "1.025"}, {})
    rows = df.select("i", scoring.clinical_score(field).alias("c"), scoring.research_score(field).alias("r")).orderBy("i").collect()
    assert rows[0]["c"] == pytest.approx(0.2 + 0.12 + 0.12 + 0.15)
    assert rows[1]["r"] == pytest.approx(0.068) and rows[2]["r"] == 0.18


def test_band_edges(spark):
    df = spark.createDataFrame([(0.7,), (0.69999,), (0.4,), (0.1,)], "s double")
    assert [r[0] for r in df.select(scoring.band(F.col("s"))).collect()] == ["high_risk", "moderate_risk", "moderate_risk", "lower_risk"]


def test_translation_is_conservative(spark):
    df, field = inputs(spark, {"age": "50", "scr": "1.1", "dm": "Y", "egfr": "60", "cvd": "no", "sbp": "140"})
    view = scoring.translated(field)
    row = df.select(*[view(f).alias(f) for f in ("age", "sc", "dm", "htn", "hemo")], scoring.translation_notes(field).alias("notes")).first()
    assert (row["age"], row["sc"], row["dm"], row["htn"], row["hemo"]) == ("50.0", "1.1", "yes", None, None)
    assert row["notes"] == [fixed.TRANSLATION_NOTES["cvd"], fixed.TRANSLATION_NOTES["egfr"]]


def test_normalized_response(spark):
    body = {"score": 0.8, "explanation": [{"feature": "a", "message": "Protective"}, {"contribution": "0.2"}] + [{}] * 6}
    df = spark.createDataFrame([(json.dumps(body),), ("{}",)], "b string")
    rows = df.select(*scoring.normalized_response(F.col("b"))).collect()
    assert rows[0]["risk_score"] == 0.8 and rows[0]["prediction_label"] == "unknown"
    got = [(e["feature"], e["contribution"], e["direction"]) for e in rows[0]["explanation"]]
    assert got == [
        ("a", -0.16, "negative"), ("feature_2", 0.2, "positive"), ("feature_3", 0.1, "positive"),
        ("feature_4", 0.08, "positive"), ("feature_5", 0.06, "positive"), ("feature_6", 0.05, "positive"),
    ]
    assert rows[1]["risk_score"] == 0.0 and rows[1]["explanation"] == []


def test_ranges_and_completeness(spark):
    df = spark.createDataFrame([("17", "120", " ")], "age string, sbp string, dbp string")
    states = {r["field"]: r["state"] for r in scoring.range_states(df, []).collect()}
    assert (states["age"], states["sbp"], states["dbp"], states["bmi"]) == ("out_of_range", "in_range", "blank", "blank")
    filled, state = scoring.completeness(scoring.fields(df), ["age", "sbp", "dbp"])
    assert tuple(df.select(filled, state).first()) == (2, "partial")


def test_unknown_category_code(spark):
    df = spark.createDataFrame([("a",), ("zz",), (None,)], "v string")
    assert [r[0] for r in df.select(scoring.encoded(F.col("v"), {"a": 0, "unknown": 5})).collect()] == [0.0, 5.0, None]
    assert [r[0] for r in df.select(scoring.encoded(F.col("v"), {"a": 0})).collect()] == [0.0, None, None]


BODIES = [
    ('{"mode": " Clinical ", "inputs": {"age": 50, "dm": null}}', False, "clinical", None),
    ('{"context": {"case_id": "1"}, "payload": {"sc": 1.5}}', False, "research", None),
    (base64.b64encode(b'{"inputs": {"sc": "2"}}').decode(), True, "research", None),
    ("{broken", False, None, "invalid_json"),
    ("", False, "research", "missing_inputs"),
    ('{"mode": "batch", "inputs": {}}', False, "batch", "unsupported_mode"),
    ('{"context": {"case_id": "1"}, "x": 3}', False, "research", "missing_inputs"),
]


def test_request_bodies(spark):
    df = spark.createDataFrame([(i, b, c) for i, (b, c, _, _) in enumerate(BODIES)], "i int, body string, coded boolean")
    rows = parse_requests(df, "body", "coded").orderBy("i").collect()
    assert [(r["mode"], r["rejection"]) for r in rows] == [(m, e) for _, _, m, e in BODIES]
    assert rows[0]["inputs"] == {"age": "50", "dm": None} and rows[1]["inputs"] == {"sc": "1.5"}
    assert rows[1]["context"]["case_id"] == "1"
    scored = score_requests(df, "body", ["i"], "coded").orderBy("i").collect()
    assert [(r["i"], r["serving_route"]) for r in scored] == [(0, "/predict/clinical"), (1, "/predict/research"), (2, "/predict/research")]


def test_only_a_whole_object_is_a_body(spark):
    bodies = [
        '{"inputs": {"sc": "1.4"}}', '{"inputs": "{\\"sc\\": 1}"}', '{"inputs": {"sc": 1}} trailing', '{"inputs": {}}, {}', "", "[1]",
        '{"mode": "research", "fields": {"sc": 2}}',
    ]
    rows = parse_requests(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"), "body").orderBy("i").collect()
    assert [r["rejection"] for r in rows] == [None, "missing_inputs", "invalid_json", "invalid_json", "missing_inputs", "invalid_json", None]
    assert rows[0]["inputs"] == {"sc": "1.4"} and rows[6]["inputs"] == {"sc": "2"}
