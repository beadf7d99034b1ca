"""Reproducible stratified splits and folds with exact sizes.

Rows are ordered by a seeded digest inside each stratum. A split is a digest
threshold per stratum and a fold is the number of thresholds below a row, so
assigning a row is a comparison in the scan: the table is neither sorted nor
shuffled. Thresholds come from a histogram of digest prefixes plus an exact
look at the few rows that share the boundary prefix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskloom.fixed import FOLDS, SEED, TEST_SHARE
from riskloom.functions.hashing import digest, prefix_length
from riskloom.operators.contracts import require_columns
from riskloom.operators.keys import join_groups
from riskloom.operators.profile import fingerprint, shares
from riskloom.operators.ranking import row_numbers

#: Strata up to which their thresholds are sent to all tasks; beyond, the table is joined by stratum.
BROADCAST_STRATA = 10_000


def stratum_sizes(df: DataFrame, stratum: str) -> DataFrame:
    """(_s, n): row count per stratum; rows without a stratum are one of them."""
    return df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("n"))


def part_sizes(sizes: DataFrame, share: float, rows: int, strata: int) -> DataFrame:
    """(_s, position): rows of each stratum that go to the test part; they add up to ceil(share * rows).

    Every stratum gives the whole part of its share, and those with the largest remainder one row more. Up to
    BROADCAST_STRATA strata are ranked in one window; more are ranked by ranges of the order.
    """
    part = F.lit(share) * F.col("n")
    named = F.coalesce(F.col("_s").cast("string"), F.lit("")).alias("name")
    floors = sizes.select("_s", F.floor(part).alias("whole"), (F.floor(part) - part).alias("short"), named)
    order = ["short", "name", "_s"]
    if strata <= BROADCAST_STRATA:
        ranked = floors.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    else:
        ranked = row_numbers(floors, order, "place")
    extra = F.lit(math.ceil(share * rows)) - floors.agg(F.sum("whole")).scalar()
    return ranked.select("_s", (F.col("whole") + (F.col("place") <= extra).cast("int")).alias("position"))


def digest_cuts(df: DataFrame, key: str, stratum: str, positions: DataFrame, seed: int, rows: int) -> DataFrame:
    """(stratum, cuts): the digest and key of the rows at the given places (_s, _cut, position) of each stratum.

    Prefixes of digests, as long as the number of rows asks for, part the rows into small groups.
    """
    hashed = df.select(F.col(stratum).alias("_s"), F.col(key).alias("_k"), digest(seed, F.col(key)).alias("_h"))
    hashed = hashed.withColumn("_p", F.substring("_h", 1, prefix_length(rows)))
    along = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    histogram = hashed.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n"))
    histogram = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    boundary = join_groups(histogram, positions.where("position > 0"), ["_s"]).filter(
        (F.col("_before") < F.col("position")) & (F.col("position") <= F.col("_before") + F.col("_n"))
    )
    boundary = boundary.select("_s", "_p", "_cut", (F.col("position") - F.col("_before")).alias("_place"))
    inside = Window.partitionBy("_s", "_cut").orderBy("_h", "_k")
    exact = join_groups(hashed, boundary, ["_s", "_p"]).withColumn("_rank", F.row_number().over(inside))
    return (
        exact.filter(F.col("_rank") == F.col("_place"))
        .groupBy(F.col("_s").alias(stratum))
        .agg(F.collect_list(F.struct("_h", "_k")).alias("_cuts"))
    )


def _placed(df: DataFrame, key: str, stratum: str, cuts: DataFrame, seed: int, strata: int) -> DataFrame:
    joined = join_groups(df, F.broadcast(cuts) if strata <= BROADCAST_STRATA else cuts, [stratum], "left")
    me = F.struct(digest(seed, F.col(key)).alias("_h"), F.col(key).alias("_k"))
    return joined.withColumn("_me", me)


def _measured(df: DataFrame, stratum: str) -> tuple[DataFrame, int, int]:
    """Sizes of the strata, number of rows and of strata."""
    sizes = stratum_sizes(df, stratum)
    row = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("strata")).first()
    return sizes, row["rows"], row["strata"]


def stratified_split(
    df: DataFrame, key: str, stratum: str, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add `split` = train / test with exact sizes in every stratum."""
    sizes, rows, strata = _measured(df, stratum)
    places = part_sizes(sizes, share, rows, strata).withColumn("_cut", F.lit(0))
    placed = _placed(df, key, stratum, digest_cuts(df, key, stratum, places, seed, rows), seed, strata)
    in_test = F.coalesce(F.exists("_cuts", lambda c: F.col("_me") <= c), F.lit(False))
    return placed.withColumn("split", F.when(in_test, "test").otherwise("train")).select(*df.columns, "split")


def stratified_folds(df: DataFrame, key: str, stratum: str, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add `fold` in 0..folds-1; the sizes of two folds differ by at most one row per stratum."""
    sizes, rows, strata = _measured(df, stratum)
    ends = F.transform(F.sequence(F.lit(1), F.lit(folds - 1)), lambda i: F.ceil(i * F.col("n") / folds)) if folds > 1 else F.array().cast("array<long>")
    places = sizes.select("_s", F.posexplode(ends).alias("_cut", "position"))
    placed = _placed(df, key, stratum, digest_cuts(df, key, stratum, places, seed, rows), seed, strata)
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_me")))
    return placed.withColumn("fold", F.greatest(below, F.lit(0)).cast("int")).select(*df.columns, "fold")


def split_table(df: DataFrame, key: str, target: str) -> DataFrame:
    """Split file layout: row key, split, target."""
    return df.select(F.col(key).alias("row_index"), "split", F.col(target).alias("target"))


def split_check(df: DataFrame, key: str, split: DataFrame) -> DataFrame:
    """Class distribution per part, and whether the split covers the table exactly once."""
    require_columns(split, ("row_index", "split", "target"), "split")
    counts = split.groupBy("split", "target").agg(F.count(F.lit(1)).alias("row_count"))
    coverage = (
        df.select(F.col(key).alias("row_index"), F.lit(1).alias("d"), F.lit(0).alias("s"))
        .unionByName(split.select("row_index", F.lit(0).alias("d"), F.lit(1).alias("s")))
        .groupBy("row_index")
        .agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
        .agg(F.count_if((F.col("d") != 1) | (F.col("s") != 1)).alias("n"))
    )
    return shares(counts, ["split"]).withColumn("split_matches_rows", F.lit(0) == coverage.scalar())


def take_split(df: DataFrame, key: str, split: DataFrame, part: str) -> DataFrame:
    """Rows of one part, by key."""
    chosen = split.filter(F.col("split") == part).select(F.col("row_index").alias(key))
    return df.join(chosen, key, "left_semi")


def split_leakage(df: DataFrame, key: str, features: Sequence[str], split: str = "split") -> DataFrame:
    """Ids in both parts, and distinct feature rows that occur in both parts."""
    train, test = F.col(split) == "train", F.col(split) == "test"

    def shared(rows: DataFrame) -> DataFrame:
        return rows.agg(F.count_if(F.col("in_train") & F.col("in_test")).alias("n"))

    sides = [F.bool_or(train).alias("in_train"), F.bool_or(test).alias("in_test")]
    ids = df.groupBy(key).agg(*sides)
    rows = df.groupBy(F.unhex(fingerprint(df, features)).alias("_row")).agg(*sides)
    return df.agg(F.count_if(train).alias("train_count"), F.count_if(test).alias("test_count")).withColumns(
        {
            "index_overlap_count": shared(ids).scalar(),
            "exact_feature_row_overlap_count": shared(rows).scalar(),
        }
    )


def overlap_examples(df: DataFrame, key: str, split: str = "split", limit: int = 10) -> DataFrame:
    """The smallest ids that are in both parts."""
    return (
        df.groupBy(key)
        .agg(F.count_distinct(split).alias("parts"))
        .filter("parts > 1")
        .orderBy(key)
        .limit(limit)
        .select(key)
    )
