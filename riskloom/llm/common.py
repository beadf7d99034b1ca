"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import run_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z as a-z; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: its lineage ends there.

    A lost executor can't take the rows with it, as it could with a cached table.
    """
    folder = run_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fewest(df: DataFrame, rows: int, key: Column, *ties: str | Column) -> DataFrame:
    """At most `rows` rows of `df`, those first in the order of the hash of `key` and then of `ties`.

    Rows are counted first, and only those whose hash lies so low that about `rows` are left are sorted: what reaches one task
    does not grow with the table or its partitions.
    """
    total = df.count()
    order = F.xxhash64(key)
    if total > rows:
        share = (rows + 8 * rows**0.5 + 32) / total
        if share < 1:
            df = df.where(order < F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(order, *ties).limit(rows)


def batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str
) -> DataFrame:
    """Apply `function` to the Arrow batches of `df`, cut so that very long texts stay few in one batch."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in slices(batch):
                out = function(part)
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """Slices of about `most` bytes each."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
