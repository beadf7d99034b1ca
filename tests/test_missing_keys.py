import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, monitor, ranking


def test_midranks_and_running_values_of_a_missing_group(spark):
    rows = [(None, 1.0), (None, 2.0), (None, 2.0), ("a", 5.0)]
    found = ranking.midranks(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()
    assert {(r["g"], r["x"]): r["midrank"] for r in found} == {(None, 1.0): 1.0, (None, 2.0): 2.5, ("a", 5.0): 1.0}


def test_window_metrics_of_a_missing_group(spark):
    log = spark.createDataFrame([(None, 60, 5.0), (None, 61, 7.0), ("a", 60, 1.0)], "g string, t long, ms double")
    log = log.withColumn("t", F.timestamp_seconds("t"))
    found = {r["g"]: r["p95_ms"] for r in monitor.window_metrics(log, "t", "ms", F.lit(False), groups=["g"]).collect()}
    assert found["a"] == 1.0 and found[None] is not None


def test_a_prediction_without_a_score_fails(spark):
    rows = spark.createDataFrame([("m", 1, 1, 0.5), ("m", 0, 1, None)], "model_name string, target_true int, prediction_label int, risk_score double")
    with pytest.raises(Exception, match="no score"):
        metrics.metric_table(rows, ["model_name"]).collect()
