import math
from collections import Counter

from pyspark.sql import functions as F

from riskloom.operators import split


def table(spark, n=997):
    """One class holds most rows."""
    return spark.createDataFrame([(i, int(i % 10 == 0), i % 3) for i in range(n)], "k long, y int, x int")


def test_sizes_are_exact_and_layout_does_not_matter(spark):
    df = table(spark)
    one = {r["k"]: r["split"] for r in split.stratified_split(df, "k", "y").collect()}
    two = {r["k"]: r["split"] for r in split.stratified_split(df.repartition(7, "x"), "k", "y").collect()}
    assert one == two and len(one) == 997
    assert Counter(one.values())["test"] == math.ceil(0.2 * 997)
    tests = Counter(k % 10 == 0 for k, s in one.items() if s == "test")
    assert tests[True] == 20 and tests[False] == 180
    other = {r["k"]: r["split"] for r in split.stratified_split(df, "k", "y", seed=1).collect()}
    assert other != one


def test_fold_sizes_differ_by_at_most_one(spark):
    counts = Counter((r["y"], r["fold"]) for r in split.stratified_folds(table(spark), "k", "y", 5).collect())
    for y in (0, 1):
        sizes = [counts[(y, f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and min(sizes) > 0


def test_tiny_strata(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "k long, y int")
    assert split.stratified_split(df, "k", "y").count() == 2
    assert split.stratified_folds(df, "k", "y", 5).count() == 2


def test_rows_without_a_stratum_are_a_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(100)], "k long, y int")
    tests = Counter(r["y"] for r in split.stratified_split(df, "k", "y").collect() if r["split"] == "test")
    assert tests == {None: 10, 1: 10}
    assert Counter((r["y"], r["fold"]) for r in split.stratified_folds(df, "k", "y", 5).collect())[None, 4] == 10


def test_more_than_a_thousand_strata(spark):
    df = spark.createDataFrame([(i, i % 1500) for i in range(6000)], "k long, y int")
    parts = split.stratified_split(df, "k", "y").collect()
    tests = Counter(r["y"] for r in parts if r["split"] == "test")
    assert len(parts) == 6000 and sum(tests.values()) == 1200 and max(tests.values()) == 1


def test_check_and_leakage(spark):
    df = table(spark, 100)
    parts = split.stratified_split(df, "k", "y")
    layout = split.split_table(parts, "k", "y")
    assert all(r["split_matches_rows"] for r in split.split_check(df, "k", layout).collect())
    assert not any(r["split_matches_rows"] for r in split.split_check(df, "k", layout.filter("row_index > 3")).collect())
    leak = split.split_leakage(parts, "k", ["x"]).first()
    assert leak["index_overlap_count"] == 0 and leak["exact_feature_row_overlap_count"] == 3
    assert split.take_split(df, "k", layout, "test").count() == 20


def test_more_strata_than_one_window_takes(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 701).alias("s"))
    whole = {r["id"]: r["split"] for r in split.stratified_split(df, "id", "s").collect()}
    monkeypatch.setattr(split, "BROADCAST_STRATA", 10)
    spread = split.stratified_split(df, "id", "s")
    assert {r["id"]: r["split"] for r in spread.collect()} == whole
    assert sum(v == "test" for v in whole.values()) == 600
