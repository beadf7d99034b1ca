"""A small table that every batch of a stream replaces, kept in two folders by turns and a pointer to the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

SLOTS = 2


def slot(path: str, batch_id: int) -> str:
    return f"{path}/slot={batch_id % SLOTS}"


def before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before left; a repeated batch finds the same."""
    return spark.read.parquet(slot(path, batch_id - 1)) if batch_id > 0 else None


def replace(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the table of this batch over that of the batch before the last one, then point at it."""
    rows.write.mode("overwrite").parquet(slot(path, batch_id))
    pointer = rows.sparkSession.createDataFrame([(batch_id,)], "batch long")
    pointer.coalesce(1).write.mode("overwrite").json(f"{path}/newest")


def newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that the pointer names; nothing before the first batch."""
    try:
        row = spark.read.schema("batch long").json(f"{path}/newest").first()
    except AnalysisException:
        return None
    return None if row is None else spark.read.parquet(slot(path, row["batch"]))
