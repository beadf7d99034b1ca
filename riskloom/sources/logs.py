"""Log lines: run reports with optional start-up time, and access logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.fixed import REPORT_FIELDS, REPORT_PATTERN, REPORT_PREFIX
from riskloom.operators.monitor import latest

ACCESS_SCHEMA = "timestamp timestamp, routeKey string, status string, responseLatency double, path string, sourceIp string"


def parse_reports(lines: DataFrame, message: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of report lines; other lines are dropped by a cheap prefix test before any pattern runs."""
    text = F.col(message)
    first, *rest = REPORT_FIELDS
    columns = [F.nullif(F.regexp_extract(text, REPORT_PATTERN, 1), F.lit("")).alias(first)]
    columns += [F.regexp_extract(text, REPORT_PATTERN, i).try_cast("double").alias(name) for i, name in enumerate(rest, 2)]
    parsed = lines.filter(text.startswith(REPORT_PREFIX)).select(*keep, *columns)
    complete = [name for name in REPORT_FIELDS if name != "init_duration_ms"]
    return parsed.dropna(subset=complete)


def cold_starts(lines: DataFrame, message: str, time: str, since=None, limit: int = 5) -> DataFrame:
    """The newest report lines that carry a start-up time; `time` is in epoch milliseconds."""
    chosen = lines if since is None else lines.filter(F.col(time) >= since)
    parsed = parse_reports(chosen, message, (time,)).filter("init_duration_ms is not null")
    stamp = F.date_format(F.timestamp_millis(F.col(time)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return latest(parsed.withColumn("timestamp_utc", stamp), [F.desc(time), F.asc("request_id")], limit)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCESS_SCHEMA).json(path).select("timestamp", "routeKey", "status", "responseLatency")
