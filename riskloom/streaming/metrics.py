"""Windowed request metrics and alarms on a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.fixed import Alarm
from riskloom.operators.keys import join_groups
from riskloom.operators.monitor import alarm_states
from riskloom.streaming.versions import before, replace

LATE = "10 minutes"


def windowed(
    log: DataFrame,
    time: str,
    latency: str,
    error: Column,
    seconds: int = 60,
    groups: Sequence[str] = (),
    late: str = LATE,
    accuracy: int = 10000,
    server_error: Column | None = None,
) -> DataFrame:
    """Tumbling-window errors, server errors and latency quantiles behind a watermark.

    The quantiles are sketches, so the state of a window does not grow with its
    rows; their rank error is at most 1 / accuracy.
    """
    places = F.percentile_approx("_ms", F.array(F.lit(0.5), F.lit(0.95)), accuracy)
    return (
        log.select(
            *groups,
            F.col(time).cast("timestamp").alias("_ts"),
            F.col(latency).alias("_ms"),
            error.cast("int").alias("_error"),
            (F.lit(0) if server_error is None else server_error.cast("int")).alias("_server_error"),
        )
        .withWatermark("_ts", late)
        .groupBy(F.window("_ts", f"{seconds} seconds").alias("_w"), *groups)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("_error").alias("errors"),
            F.sum("_server_error").alias("server_errors"),
            F.max("_ms").alias("max_ms"),
            places.alias("_p"),
        )
        .select(
            *groups,
            F.unix_seconds(F.col("_w.start")).alias("period"),
            "requests",
            "errors",
            "server_errors",
            "max_ms",
            F.col("_p")[0].alias("p50_ms"),
            F.col("_p")[1].alias("p95_ms"),
        )
    )


def alarm_sink(
    metrics_path: str, states_path: str, value: str, alarm: Alarm, groups: Sequence[str], seconds: int
) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps finished periods and decides an alarm over them.

    A period without requests emits no row, so the alarm is decided on the dense calendar from the last period known of a
    group to the newest one. What a batch needs of earlier ones is the last N periods of each group; it keeps these in one
    of two folders by turns. So its work depends on the new periods and the groups alone. The states of new periods go to a
    folder of their batch, which a repeated batch replaces.
    """
    tails = f"{states_path}_tails"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, [*groups, "period", value]
        batch.write.mode("overwrite").parquet(f"{metrics_path}/batch={batch_id}")
        new = spark.read.schema(batch.schema).parquet(f"{metrics_path}/batch={batch_id}").select(*columns)
        known = before(spark, tails, batch_id)
        rows = new if known is None else known.select(*columns).unionByName(new)
        states = alarm_states(rows, value, alarm, groups, seconds)
        fresh = states
        if known is not None:
            ends = known.groupBy(*groups).agg(F.max("period").alias("_end"))
            ended = join_groups(states, ends, groups, "left") if groups else states.join(F.broadcast(ends), how="left")
            fresh = ended.where(F.col("_end").isNull() | (F.col("period") > F.col("_end"))).drop("_end")
        fresh.write.mode("overwrite").parquet(f"{states_path}/batch={batch_id}")
        last = Window.partitionBy(*groups).orderBy(F.desc("period"))
        tail = states.select(*columns, F.row_number().over(last).alias("_place")).where(F.col("_place") <= max(alarm.periods - 1, 1))
        replace(tail.drop("_place"), tails, batch_id)

    return write


def read_alarms(spark: SparkSession, states_path: str) -> DataFrame:
    """States of all periods so far."""
    return spark.read.parquet(states_path).drop("batch")


def start_alarms(metrics: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    return (
        metrics.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
