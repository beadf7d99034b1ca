"""Run log around a job: started, success or failed with the error."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import TypeVar

from pyspark.sql import SparkSession

Result = TypeVar("Result")
SCHEMA = "run_name string, status string, timestamp string, error_type string, error_message string"


def logged(spark: SparkSession, path: str, name: str, job: Callable[[], Result]) -> Result:
    """Run a job and append its life to a run-log table."""

    def note(status: str, error: Exception | None = None) -> None:
        stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        kind, message = (type(error).__name__, str(error)) if error else (None, None)
        spark.createDataFrame([(name, status, stamp, kind, message)], SCHEMA).write.mode("append").json(path)

    note("started")
    try:
        result = job()
    except Exception as error:
        note("failed", error)
        raise
    note("success")
    return result
