"""Exact ordered computations without a single-task window.

A running total over a whole group is cut into value ranges. Equal values share
a range, so ties stay together; each range is one small window; range totals
(a bounded table) supply what lies before the range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskloom.operators.keys import join_groups
from riskloom.session import checkpoint, order_buckets, shuffle_partitions

BUCKET = "_range"


def range_cuts(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Increasing cut points that hold about the same number of rows each.

    One narrow pass with a quantile sketch; only the cut points reach the driver.
    """
    buckets = buckets or order_buckets(df.sparkSession)
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = df.select(F.col(order).cast("double").alias(order)).approxQuantile(
        order, probabilities, 1.0 / (2 * buckets)
    )
    return sorted({float(c) for c in cuts if c is not None})


def with_range(df: DataFrame, order: str, cuts: Sequence[float]) -> DataFrame:
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *[c for c in cuts if c not in (float("-inf"), float("inf"))], float("inf")]
    if len(splits) < 3:
        return df.withColumn(BUCKET, F.lit(0))
    column = "_order_value"
    staged = df.withColumn(column, F.col(order).cast("double"))
    staged = Bucketizer(splits=splits, inputCol=column, outputCol=BUCKET, handleInvalid="keep").transform(staged)
    return staged.withColumn(BUCKET, F.coalesce(F.col(BUCKET).cast("int"), F.lit(0))).drop(column)


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    counts: Sequence[str],
    cuts: Sequence[float],
) -> DataFrame:
    """Add `before_<c>` and `total_<c>` for each count column.

    `df` has one row per (groups, order value). `before_<c>` sums the rows of the
    group with a smaller order value.
    """
    ranged = with_range(df, order, cuts)
    keys = [*groups, BUCKET]
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)

    offsets = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{c}") for c in counts])
    offsets = offsets.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(along), F.lit(0)).alias(f"_off_{c}") for c in counts],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in counts],
    )
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in counts])
    joined = join_groups(local, offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"before_{c}") for c in counts],
        *[f"total_{c}" for c in counts],
    )


def row_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the place of every row, from 1, under an order that leaves no ties.

    The rows are parted by ranges of the order and numbered inside each; one
    count per range reaches the driver.
    """
    parts = order_buckets(df.sparkSession)
    ranged = checkpoint(df.repartitionByRange(parts, *order).withColumn(BUCKET, F.spark_partition_id()))
    before, offsets = 0, []
    for row in ranged.groupBy(BUCKET).count().orderBy(BUCKET).collect():
        offsets.append((row[BUCKET], before))
        before += row["count"]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, f"{BUCKET} int, _before long"))  # one row per range
    inside = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*order))
    return ranged.withColumn(name, inside).join(table, BUCKET).withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def midranks(df: DataFrame, groups: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """One row per distinct value: tie count and averaged rank inside the group."""
    cuts = range_cuts(df, value, buckets)
    ties = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("ties"))
    return running_totals(ties, groups, value, ["ties"], cuts).select(
        *groups,
        value,
        "ties",
        (F.col("before_ties") + (F.col("ties") + 1) / 2.0).alias("midrank"),
    )


HOT_SHARE = 0.001
HOT_SALTS = 64


def spread_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, row_key: str) -> DataFrame:
    """Join rows to a table with one row per key, where a few keys may hold most rows.

    `weight` tells how many rows each key has. Keys with more than a thousandth of
    all rows - at most a thousand keys, whatever the data - are spread over salts,
    as many as the session has shuffle partitions.
    """
    salts = max(HOT_SALTS, shuffle_partitions(rows.sparkSession))
    total = table.agg(F.sum(weight)).scalar()
    heavy = F.col(weight) > F.lit(HOT_SHARE) * total
    hot = F.broadcast(table.filter(heavy).select(*keys, F.lit(salts).alias("_salts")))
    salted_rows = rows.join(hot, list(keys), "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int")),
    )
    salted_table = table.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.when(heavy, F.lit(salts - 1)).otherwise(F.lit(0))))
    ).drop(weight)
    return salted_rows.join(salted_table, [*keys, "_salt"]).drop("_salt", "_salts")


def running_last(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, name: str, cuts: Sequence[float]
) -> DataFrame:
    """Add the last filled `value` of earlier rows of the group under the given order.

    The first order column is numeric and is cut into ranges; what earlier ranges
    end with is a table of one row per (group, range).
    """
    head = order[0]
    ranged = with_range(df, head, cuts)
    keys = [*groups, BUCKET]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = ranged.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_end"))
    carried = ends.select(*keys, F.last("_end", ignorenulls=True).over(along).alias("_carried"))
    local = ranged.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return join_groups(local, carried, keys).select(*df.columns, F.coalesce("_inside", "_carried").alias(name))
