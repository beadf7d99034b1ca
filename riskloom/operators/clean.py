"""Minimal cleaning and exact label encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import blank_to_null, looks_numeric, number
from riskloom.operators.contracts import ContractError


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def trim_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = set(text_columns(df) if columns is None else columns)
    return df.select(*[blank_to_null(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def numeric_verdict(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: filled cells, numeric cells, and whether the column may become numeric.

    All columns share one pass.
    """
    columns = list(text_columns(df) if columns is None else columns)
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(F.col(c)).alias("filled"),
                    F.count_if(looks_numeric(F.col(c))).alias("numeric"),
                )
                for c in columns
            ]
        ).alias("_columns")
    )
    return counts.select(F.inline("_columns")).withColumn(
        "coerced", (F.col("filled") > 0) & (F.col("filled") == F.col("numeric"))
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn a text column into numbers only when every filled cell is a number."""
    verdict = numeric_verdict(df, columns)
    chosen = {r["column"] for r in verdict.filter("coerced").select("column").collect()}
    return df.select(*[number(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def minimal_clean(df: DataFrame) -> DataFrame:
    return coerce_numeric(trim_cells(df))


def label_column(raw: Column, labels: Mapping[str, int]) -> Column:
    """Exact look-up in a fixed map; other values are missing."""
    pairs = [p for text, code in labels.items() for p in (F.lit(text), F.lit(code))]
    return F.try_element_at(F.create_map(*pairs), raw)


def unresolved_labels(df: DataFrame, column: str, labels: Mapping[str, int]) -> DataFrame:
    """Values without a code (missing included) and how often they occur."""
    return (
        df.filter(label_column(F.col(column), labels).isNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def encode_labels(df: DataFrame, column: str, labels: Mapping[str, int], target: str = "target") -> DataFrame:
    """Encode a label column, or fail with the values that have no code."""
    if set(labels.values()) - {0, 1}:
        raise ContractError(f"Label map has codes other than 0 and 1: {labels}")
    open_values = [r["value"] for r in unresolved_labels(df, column, labels).limit(20).collect()]
    if open_values:
        raise ContractError(f"Unresolved values in {column}: {open_values}")
    return df.withColumn(target, label_column(F.col(column), labels))
