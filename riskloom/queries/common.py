"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, so that the order of a sum does not show."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def number_columns(df: DataFrame) -> DataFrame:
    """Integers of every width as long."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("long").alias(f.name)
            if isinstance(f.dataType, T.IntegralType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def final(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return number_columns(tidy(df, digits))


def text(value: str) -> str:
    """SQL text literal."""
    return "'" + value.replace("'", "''") + "'"


HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


HASH_LONG = "('0x' || substr(md5({0}), 1, 15))::BIGINT"


def sql_hash_long(*parts: str) -> str:
    return HASH_LONG.format(" || '|' || ".join(parts))


def sql_hash(*parts: str) -> str:
    return HASH.format(" || '|' || ".join(parts))
