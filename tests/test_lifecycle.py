import pytest

from riskloom.operators import lifecycle as L
from riskloom.operators.contracts import ContractError

SCHEMA = "event_time long, event_id string, event_type string, model_id string"
LOG = [
    (1, "a", "registered", "m1"),
    (2, "b", "approved", "m1"),
    (3, "c", "promoted", "m1"),
    (4, "d", "registered", "m2"),
    (5, "e", "promoted", "m2"),  # never approved
    (6, "f", "approved", "m2"),  # active by then
    (7, "g", "promoted", "m2"),  # active by then
    (8, "h", "rolled_back", "m1"),
    (8, "i", "promoted", "m1"),  # same time, already active
    (9, "j", "retired", "m2"),
    (10, "k", "approved", "m2"),  # retired
]


def test_state_and_replay_in_any_order(spark):
    for rows in (LOG, LOG[::-1]):
        state = {r["model_id"]: (r["status"], r["active_model_id"]) for r in L.model_state(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert state == {"m1": ("active", "m1"), "m2": ("approved", "m1")}


def test_promotion_demotes_the_other_model(spark):
    state = {r["model_id"]: r["status"] for r in L.model_state(spark.createDataFrame(LOG[:7], SCHEMA)).collect()}
    assert state == {"m1": "approved", "m2": "active"}


def test_refused_transitions(spark):
    found = {r["event_id"]: r["violation"] for r in L.transition_audit(spark.createDataFrame(LOG, SCHEMA)).collect()}
    assert found == {
        "e": "only_approved_can_be_promoted",
        "f": "active_is_already_approved",
        "g": "already_active",
        "i": "already_active",
        "k": "retired_cannot_be_approved",
    }


def test_rollback_target(spark):
    assert L.rollback_targets(spark.createDataFrame(LOG[:7], SCHEMA)).first()["rollback_model_id"] == "m1"
    assert L.rollback_targets(spark.createDataFrame(LOG[:3], SCHEMA)).first()["rollback_model_id"] is None


def test_merged_facts_equal_one_replay(spark):
    one, two = spark.createDataFrame(LOG[:5], SCHEMA), spark.createDataFrame(LOG[5:], SCHEMA)
    merged = L.state_of(L.merge_facts(L.model_facts(two), L.model_facts(one)))
    assert sorted(merged.collect()) == sorted(L.model_state(spark.createDataFrame(LOG, SCHEMA)).collect())


def models(spark, *rows):
    return spark.createDataFrame(rows, "model_id string, status string")


def test_upsert(spark):
    out = L.upsert(models(spark, ("a", "active"), ("b", "approved")), models(spark, ("b", "candidate")), ["model_id"], True)
    assert sorted(map(tuple, out.collect())) == [("a", "approved"), ("b", "active")]


def test_active_model_resolution(spark):
    rows = [("r1", "a", "approved"), ("r1", "b", "approved"), ("r2", "c", "active"), ("r2", "d", "approved"), ("r3", "e", "candidate")]
    table = spark.createDataFrame(rows, "registry string, model_id string, status string")
    named = spark.createDataFrame([("r1", "b")], "registry string, active_model_id string")
    got = {r["registry"]: (r["resolution"], r["active_model_id"]) for r in L.resolve_active(table, named, ["registry"]).collect()}
    assert got == {"r1": ("named", "b"), "r2": ("only_active", "c"), "r3": ("only_model", "e")}
    with pytest.raises(ContractError):
        L.require_active(table, named.filter("false"), ["registry"])


def test_consistency(spark):
    L.consistency(models(spark, ("a", "active")), models(spark, ("a", "active")).select("model_id"))
    with pytest.raises(ContractError):
        L.consistency(models(spark, ("a", "gone")), models(spark, ("a", "x")).select("model_id"))
    with pytest.raises(ContractError):
        L.consistency(models(spark, ("a", "active")), models(spark, ("z", "x")).select("model_id"))
