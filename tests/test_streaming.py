import json
import random

from pyspark.sql import functions as F

from riskloom.fixed import Alarm
from riskloom.operators import lifecycle, monitor
from riskloom.streaming.lifecycle import read_registry, registry_sink, start_registry
from riskloom.streaming.metrics import alarm_sink, read_alarms, start_alarms, windowed
from riskloom.streaming.scoring import score_requests, start_scoring
from tests.test_lifecycle import LOG, SCHEMA


def test_scoring_stream_equals_batch(spark, tmp_path):
    body = lambda i: json.dumps({"mode": ["clinical", "research", "odd"][i % 3], "inputs": {"sc": i, "scr": i, "egfr": 40}})
    spark.createDataFrame([(i, body(i)) for i in range(30)], "i int, body string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, body string").json(str(tmp_path / "in"))
    start_scoring(score_requests(stream, "body", ["i"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = score_requests(spark.read.schema("i int, body string").json(str(tmp_path / "in")), "body", ["i"])
    keep = ["i", "risk_score", "prediction_label", "serving_route"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*keep).collect()) == sorted(batch.select(*keep).collect())


def test_windows_and_alarm_equal_batch_after_the_watermark(spark, tmp_path):
    times = [i * 20 for i in range(60)] + [3000, 6000]
    rows = [(t, float(t % 97), "error" if t % 80 == 0 else "ok") for t in times]
    schema = "s long, ms double, kind string"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def shaped(df):
        return df.select(F.timestamp_seconds("s").alias("t"), "ms", "kind")

    stream = shaped(spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).json(str(tmp_path / "in")))
    alarm = Alarm("errors", "errors", "sum", 60, 3, 2, 1.0, ">=")
    sink = alarm_sink(str(tmp_path / "m"), str(tmp_path / "s"), "errors", alarm, [], 60)
    start_alarms(windowed(stream, "t", "ms", F.col("kind") == "error"), sink, str(tmp_path / "c")).awaitTermination()
    closed = monitor.window_metrics(
        shaped(spark.createDataFrame(rows, schema)), "t", "ms", F.col("kind") == "error"
    ).filter(F.col("period") + 60 <= 6000 - 600)
    got = spark.read.parquet(str(tmp_path / "m")).select("period", "requests", "errors", "max_ms")
    assert sorted(got.collect()) == sorted(closed.select("period", "requests", "errors", "max_ms").collect())
    states = read_alarms(spark, str(tmp_path / "s")).select("period", "in_alarm")
    assert sorted(states.collect()) == sorted(monitor.alarm_states(closed, "errors", alarm).select("period", "in_alarm").collect())


def test_registry_stream_equals_batch_and_repeats_are_harmless(spark, tmp_path):
    for part in (LOG[:4], LOG[4:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(SCHEMA).json(str(tmp_path / "in"))
    sink = registry_sink(str(tmp_path / "facts"))
    start_registry(stream, sink, str(tmp_path / "state")).awaitTermination()
    batch = sorted(lifecycle.model_state(spark.createDataFrame(LOG, SCHEMA)).collect())
    assert sorted(read_registry(spark, str(tmp_path / "facts")).collect()) == batch


def test_alarm_by_batches_needs_the_last_periods_only(spark, tmp_path):
    """Groups, gaps, empty and repeated batches: the states are those of the whole series, and two small tables remain."""
    draw = random.Random(3)
    rows = sorted((60 * t, g, draw.choice([0.0, 5.0])) for g in "ab" for t in draw.sample(range(60), 25))
    schema = "period long, g string, errors double"
    alarm = Alarm("errors", "errors", "sum", 60, 4, 2, 1.0, ">=")
    sink = alarm_sink(str(tmp_path / "m"), str(tmp_path / "s"), "errors", alarm, ["g"], 60)
    parts = [[], rows[:9], rows[9:10], [], rows[10:31], rows[31:]]
    for number, part in enumerate(parts):
        for _ in range(2 if number in (2, 4) else 1):
            sink(spark.createDataFrame(part, schema), number)
    whole = monitor.alarm_states(spark.createDataFrame(rows, schema), "errors", alarm, ["g"], 60)
    order = ["g", "period", "errors", "breaching", "breaches", "in_alarm"]
    assert read_alarms(spark, str(tmp_path / "s")).select(*order).orderBy("g", "period").collect() == whole.select(*order).orderBy("g", "period").collect()
    assert sorted(p.name for p in (tmp_path / "s_tails").iterdir()) == ["newest", "slot=0", "slot=1"]
    assert spark.read.parquet(str(tmp_path / "s_tails" / "slot=1")).count() == 6


def test_registry_keeps_two_tables(spark, tmp_path):
    sink = registry_sink(str(tmp_path / "facts"))
    for number in range(5):
        sink(spark.createDataFrame(LOG[number : number + 1], SCHEMA), number)
        sink(spark.createDataFrame(LOG[number : number + 1], SCHEMA), number)
    batch = sorted(lifecycle.model_state(spark.createDataFrame(LOG[:5], SCHEMA)).collect())
    assert sorted(read_registry(spark, str(tmp_path / "facts")).collect()) == batch
    assert sorted(p.name for p in (tmp_path / "facts").iterdir()) == ["newest", "slot=0", "slot=1"]
