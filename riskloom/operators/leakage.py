"""Univariate signal of features and the leakage screen built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskloom.fixed import (
    CLINICAL_CONTEXT,
    DEFAULT_CONTEXT,
    LEAKAGE_NOTES,
    MIN_OBSERVED,
    MISSING_MARK,
    TARGET_LIKE_NAMES,
)
from riskloom.operators.metrics import SCORE, TRUTH, score_cells, whole
from riskloom.operators.profile import CATEGORICAL, NUMERIC, feature_lists, type_plan
from riskloom.operators.ranking import range_cuts, running_totals


def numeric_signal(df: DataFrame, features: Sequence[str], target: str, split: str) -> DataFrame:
    """Folded single-feature AUROC per (feature, split), all features in one pass.

    Ranges of the ordered pass are cut from the pooled values, so one feature or
    split with most of the rows is still spread over many windows.
    """
    wide = df.select(F.col(split).alias("split"), F.col(target).alias(TRUTH), *[F.col(f).cast("double") for f in features])
    cells = wide.unpivot(["split", TRUTH], list(features), "feature", SCORE).filter(f"{SCORE} is not null")
    cuts = range_cuts(cells, SCORE)
    groups = ["feature", "split"]
    ordered = running_totals(score_cells(cells, groups, label=None), groups, SCORE, ["pos", "neg"], cuts)
    wins = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2))
    sums = ordered.groupBy(*groups).agg(
        whole("pos").alias("p"), whole("neg").alias("n"), F.count(F.lit(1)).alias("levels"), wins.alias("wins")
    )
    observed = F.col("p") + F.col("n")
    area = F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("n").cast("double"))
    usable = (observed >= MIN_OBSERVED) & (F.col("p") > 0) & (F.col("n") > 0) & (F.col("levels") > 1)
    return sums.select(
        *groups,
        F.when(usable, F.greatest(area, 1 - area)).alias("score"),
        observed.alias("observed_count"),
        F.lit(None).cast("long").alias("category_count"),
    )


def categorical_signal(df: DataFrame, features: Sequence[str], target: str, split: str) -> DataFrame:
    """Range of the target rate over levels per (feature, split); missing is a level of its own."""
    wide = df.select(F.col(split).alias("split"), F.col(target).alias("_y"), *[F.col(f).cast("string") for f in features])
    cells = wide.unpivot(["split", "_y"], list(features), "feature", "level")
    levels = cells.groupBy("feature", "split", F.coalesce("level", F.lit(MISSING_MARK)).alias("level")).agg(
        F.avg(F.col("_y").cast("double")).alias("rate"), F.count("level").alias("filled")
    )
    return levels.groupBy("feature", "split").agg(
        (F.max("rate") - F.min("rate")).alias("score"),
        F.sum("filled").alias("observed_count"),
        F.count(F.lit(1)).alias("category_count"),
    )


def risk(feature: Column, kind: Column, train: Column, test: Column) -> tuple[Column, Column]:
    """Leakage level and note; comparisons with a missing score are false."""
    high, low = F.greatest(train, test), F.least(train, test)
    categorical = kind == CATEGORICAL
    cases = [
        (F.lower(feature).isin(*TARGET_LIKE_NAMES), "high", LEAKAGE_NOTES["target_name"]),
        ((kind == NUMERIC) & (high >= 0.98) & (low >= 0.95), "review", LEAKAGE_NOTES["numeric"]),
        (categorical & (train >= 0.99) & (test >= 0.75), "review", LEAKAGE_NOTES["categorical"]),
        (categorical & (train >= 0.99) & (test < 0.75), "low", LEAKAGE_NOTES["train_only"]),
    ]
    level, note = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for condition, value, text in cases[1:]:
        level, note = level.when(condition, value), note.when(condition, text)
    return level.otherwise("low"), note.otherwise(LEAKAGE_NOTES["none"])


def feature_screen(df: DataFrame, target: str, split: str = "split", skip: Sequence[str] = ()) -> DataFrame:
    """Screen of every feature over train and test, strongest average signal first."""
    data = df.drop(*skip)
    numeric, text = feature_lists(data, target, (split,))
    signals = None
    for features, signal in ((numeric, numeric_signal), (text, categorical_signal)):
        if features:
            part = signal(data, features, target, split)
            signals = part if signals is None else signals.unionByName(part)
    parts = signals.groupBy("feature").agg(
        *[
            F.max(F.when(F.col("split") == part, F.col(column))).alias(f"{part}_{column}")
            for part in ("train", "test")
            for column in ("score", "observed_count", "category_count")
        ]
    )
    plan = type_plan(data.drop(split), target).withColumnRenamed("feature_name", "feature")
    feature, kind = F.col("feature"), F.col("inferred_feature_type")
    train, test = F.col("train_score"), F.col("test_score")
    average = F.when(train.isNull(), test).when(test.isNull(), train).otherwise((train + test) / 2)
    level, note = risk(feature, kind, train, test)
    return (
        plan.join(parts, "feature")
        .select(
            feature.alias("feature_name"),
            kind.alias("basic_type"),
            "dtype",
            F.col("missing_ratio").alias("missing_rate"),
            F.when(kind == NUMERIC, "single_feature_auroc").otherwise("target_rate_range").alias("signal_method"),
            train.alias("train_signal_score"),
            test.alias("test_signal_score"),
            average.alias("average_signal_score"),
            F.coalesce("train_observed_count", F.lit(0)).alias("train_observed_count"),
            F.coalesce("test_observed_count", F.lit(0)).alias("test_observed_count"),
            "train_category_count",
            level.alias("leakage_risk_level"),
            note.alias("leakage_risk_note"),
        )
        .orderBy(
            F.desc_nulls_last("average_signal_score"),
            F.desc_nulls_last("test_signal_score"),
            F.desc_nulls_last("train_signal_score"),
            "feature_name",
        )
    )


def top_features(screen: DataFrame, n: int = 10, context: Mapping[str, str] = CLINICAL_CONTEXT) -> DataFrame:
    """The strongest features with rank, assessment and review text."""
    order = (
        F.desc_nulls_last("average_signal_score"),
        F.desc_nulls_last("test_signal_score"),
        F.desc_nulls_last("train_signal_score"),
        F.asc("feature_name"),
    )
    best = screen.orderBy(*order).limit(n)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    texts = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), F.lit(v))])
    return ranked.select(
        "rank",
        "feature_name",
        "basic_type",
        "train_signal_score",
        "test_signal_score",
        "average_signal_score",
        "leakage_risk_level",
        F.when(F.col("leakage_risk_level") == "review", "review_but_clinically_plausible")
        .otherwise("strong_but_not_obviously_leaky")
        .alias("overall_assessment"),
        F.coalesce(F.try_element_at(texts, F.col("feature_name")), F.lit(DEFAULT_CONTEXT)).alias("interpretation_note"),
    )
