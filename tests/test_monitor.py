from pyspark.sql import functions as F

from riskloom.fixed import ALARMS, Alarm
from riskloom.operators import monitor
from riskloom.sources.logs import cold_starts, parse_reports


def test_latency_summary(spark):
    rows = [("r", "measured", float(v), 200, True) for v in range(1, 21)]
    rows += [("r", "measured", 900.0, 500, False), ("r", "warmup", 5000.0, 200, True), ("s", "measured", 9.0, 500, False)]
    df = spark.createDataFrame(rows, "route_name string, phase string, elapsed_ms double, status_code int, ok boolean")
    out = {r["route"]: r for r in monitor.latency_summary(monitor.measured(df)).collect()}
    r = out["r"]
    assert (r["n_total"], r["n_success"], r["n_failure"], r["mean_ms"], r["median_ms"]) == (21, 20, 1, 10.5, 10.5)
    assert (r["p95_ms"], r["p99_ms"], r["max_ms"]) == (19.05, 19.81, 20.0)
    assert out["s"]["mean_ms"] is None and out["s"]["p95_ms"] is None


def periods(spark, values):
    return spark.createDataFrame([(60 * p, v) for p, v in values.items()], "period long, p95 double")


def test_two_of_three_with_missing_periods(spark):
    alarm = Alarm("a", "duration_ms", "p95", 60, 3, 2, 3000.0, ">")
    found = monitor.alarm_states(periods(spark, {0: 4000.0, 2: 5000.0, 3: 10.0, 5: 3000.0, 6: 9000.0}), "p95", alarm)
    assert {r["period"] // 60: r["in_alarm"] for r in found.collect()} == {
        0: False, 1: False, 2: True, 3: False, 4: False, 5: False, 6: False,
    }


def test_alarm_blocks_overlap(spark):
    """Breaches on both sides of a block edge count together."""
    alarm = ALARMS[2]
    edge = 4096
    found = monitor.alarm_states(periods(spark, {edge - 1: 9000.0, edge: 9000.0, edge + 1: 1.0}), "p95", alarm)
    assert {r["period"] // 60: r["in_alarm"] for r in found.collect()} == {edge - 1: False, edge: True, edge + 1: True}


def test_window_metrics(spark):
    rows = [("2024-01-01 00:00:10", 5.0, "ok"), ("2024-01-01 00:00:59", 7.0, "bad"), ("2024-01-01 00:02:00", 1.0, "ok")]
    df = spark.createDataFrame(rows, "t string, ms double, s string").withColumn("t", F.to_timestamp("t"))
    out = monitor.window_metrics(df, "t", "ms", F.col("s") == "bad").orderBy("period").collect()
    assert [(r["requests"], r["errors"], r["p50_ms"]) for r in out] == [(2, 1, 6.0), (1, 0, 1.0)]


def test_report_lines(spark):
    base = "REPORT RequestId: {0}\tDuration: 5.5 ms\tBilled Duration: 6 ms\tMemory Size: 128 MB\tMax Memory Used: 64 MB\t"
    lines = ["START RequestId: x", base.format("a"), "REPORT RequestId: broken", "x" + base.format("c")]
    lines += [base.format(f"cold{i}") + f"Init Duration: {i}.25 ms\t" for i in range(7)]
    df = spark.createDataFrame([(i * 1000, m) for i, m in enumerate(lines)], "at long, message string")
    assert parse_reports(df, "message").count() == 8
    newest = cold_starts(df, "message", "at", since=5000).collect()
    assert [r["request_id"] for r in newest] == ["cold6", "cold5", "cold4", "cold3", "cold2"]
    assert newest[0]["init_duration_ms"] == 6.25 and newest[0]["timestamp_utc"] == "1970-01-01T00:00:10Z"


def test_latest_and_access_statistics(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i)) for i in range(10)], "t long, route string, ms double")
    assert [r["t"] for r in monitor.latest(df, [F.desc("t")], 2).collect()] == [9, 8]
    kept = monitor.latest_per_key(df, ["route"], [F.desc("t")], 2)
    assert sorted(r["t"] for r in kept.collect()) == [6, 7, 8, 9]
    busiest = monitor.access_statistics(df, "route", "route", "ms").first()
    assert (busiest["route"], busiest["requests"], busiest["max_latency_ms"]) == ("a", 6, 8.0)
