"""File sources and sinks with explicit schemas and column checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.align import join_target
from riskloom.operators.contracts import require_columns

LATENCY_SCHEMA = (
    "route_name string, phase string, iteration int, timestamp_utc string, elapsed_ms double, status_code int, "
    "ok boolean, risk_score double, prediction_label string, model_version string, serving_route string, error string"
)
PREDICTION_SCHEMA = "row_index long, target_true int, prediction_label int, risk_score double"
SPLIT_SCHEMA = "row_index long, split string, target int"
EVENT_SCHEMA = (
    "event_id string, timestamp string, event_type string, model_id string, actor string, reason string, "
    "resulting_status string, previous_active_model_id string, new_active_model_id string"
)
NA_TOKENS = ("NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "n/a", "<NA>")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header. Empty cells and the usual missing marks become missing.

    Without a schema every column is read as text, so a table of any size needs
    no inference pass; `minimal_clean` then decides which columns are numbers.
    """
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_tagged(
    spark: SparkSession, paths: Mapping[str, str], schema: str | T.StructType, tag: str = "model_name"
) -> DataFrame:
    """Several files of one layout as one table with a source column."""
    out = None
    for name, path in paths.items():
        part = read_csv(spark, path, schema).withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("No sources given")
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink; nested columns are written as JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON documents, one per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", one_each: bool = False) -> None:
    """JSON sink; with `one_each`, every row is a file of its own."""
    writer = df.write.mode(mode)
    (writer.option("maxRecordsPerFile", 1) if one_each else writer).json(path)


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """JSON lines; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path).filter(F.col("event_type").isNotNull())


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def load_dataset(
    features: DataFrame | None, targets: DataFrame | None, key: str, target: str, name: str = "dataset"
) -> DataFrame:
    """Features and targets of a dataset; both must be there and share a key."""
    if features is None or targets is None:
        raise ValueError(f"{name} is missing features or targets")
    require_columns(features, [key], f"{name} features")
    require_columns(targets, [key, target], f"{name} targets")
    return join_target(features, targets.select(key, target), key)


def write_samples(samples: DataFrame, path: str) -> None:
    """Latency samples in their fixed column order."""
    layout = T.StructType.fromDDL(LATENCY_SCHEMA)
    require_columns(samples, layout.fieldNames(), "latency samples")
    write_csv(samples.select(*[F.col(f.name).cast(f.dataType) for f in layout.fields]), path)


def write_once(df: DataFrame, path: str) -> None:
    """Write a template unless a reviewed file is already there."""
    df.write.mode("ignore").parquet(path)


def union_tables(tables: Iterable[DataFrame]) -> DataFrame:
    out = None
    for table in tables:
        out = table if out is None else out.unionByName(table)
    if out is None:
        raise ValueError("No tables given")
    return out
