"""Column alignment of two sources through a reviewed mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.fixed import (
    DROPPED_REASON,
    EXACT_MATCH_NOTE,
    SPECIAL_COLUMN_PAIRS,
    SPECIAL_PAIR_NAME,
    SPECIAL_PAIR_NOTE,
    UNMATCHED_NOTE,
)
from riskloom.functions.text import normalized_name
from riskloom.operators.clean import encode_labels, minimal_clean
from riskloom.operators.contracts import mapping_violations, require_columns, require_empty

LEFT, RIGHT = "source_a_column", "source_b_column"
MAPPING_COLUMNS = (
    LEFT,
    RIGHT,
    "unified_name",
    "same_meaning",
    "same_unit",
    "keep_for_shared_model",
    "notes",
    "manual_review_required",
)


def column_catalogue(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """Column names of a table as a table."""
    return spark.createDataFrame([(c,) for c in columns], "column string")


def candidates(
    left: DataFrame,
    right: DataFrame,
    pairs: Mapping[str, str] = SPECIAL_COLUMN_PAIRS,
    names: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """Mapping proposals from two column catalogues (`column` each).

    Equal names come first, then the known special pairs when both columns
    exist, then what is left on either side. Members of a special pair are
    never listed as left over.
    """
    spark = left.sparkSession
    special = spark.createDataFrame(list(pairs.items()) or [("", "")], f"{LEFT} string, {RIGHT} string")
    a = left.select(F.col("column").alias(LEFT), F.lit(True).alias("in_a"))
    b = right.select(F.col("column").alias(RIGHT), F.lit(True).alias("in_b"))
    both = a.join(b, F.col(LEFT) == F.col(RIGHT), "full_outer")

    def row(kind, df):
        texts = {
            "exact": ("yes", "unknown", "pending_review", F.lit(EXACT_MATCH_NOTE), "yes"),
            "special": ("uncertain", "uncertain", "pending_review", F.lit(SPECIAL_PAIR_NOTE.format(a=names[0], b=names[1])), "yes"),
            "only_a": ("no_shared_counterpart", "not_applicable", "no", F.lit(UNMATCHED_NOTE.format(source=names[0])), "no"),
            "only_b": ("no_shared_counterpart", "not_applicable", "no", F.lit(UNMATCHED_NOTE.format(source=names[1])), "no"),
        }[kind]
        meaning, unit, keep, note, review = texts
        name = F.lit(SPECIAL_PAIR_NAME) if kind == "special" else normalized_name(F.coalesce(LEFT, RIGHT))
        return df.select(
            F.coalesce(F.col(LEFT), F.lit("")).alias(LEFT),
            F.coalesce(F.col(RIGHT), F.lit("")).alias(RIGHT),
            name.alias("unified_name"),
            F.lit(meaning).alias("same_meaning"),
            F.lit(unit).alias("same_unit"),
            F.lit(keep).alias("keep_for_shared_model"),
            note.alias("notes"),
            F.lit(review).alias("manual_review_required"),
        )

    exact = row("exact", both.filter("in_a and in_b"))
    paired = row("special", special.join(a, LEFT).join(b, RIGHT).select(LEFT, RIGHT))
    only_a = row("only_a", both.filter("in_b is null").join(special.select(LEFT), LEFT, "left_anti").select(LEFT, RIGHT))
    only_b = row("only_b", both.filter("in_a is null").join(special.select(RIGHT), RIGHT, "left_anti").select(LEFT, RIGHT))
    return exact.unionByName(paired).unionByName(only_a).unionByName(only_b)


def confirmed(mapping: DataFrame) -> list[tuple[str, str, str]]:
    """The reviewed (left, right, unified) rows; fails while a row is open, blank or repeated."""
    require_columns(mapping, MAPPING_COLUMNS, "mapping")
    require_empty(mapping_violations(mapping, LEFT, RIGHT), "The mapping is not ready")
    kept = mapping.filter(F.lower(F.trim("keep_for_shared_model")) == "yes").select(LEFT, RIGHT, "unified_name")
    rows = [tuple(r) for r in kept.collect()]
    if not rows:
        raise ValueError("No mapping row is marked keep_for_shared_model=yes")
    return rows


def aligned(df: DataFrame, mapping: Sequence[tuple[str, str, str]], side: int, target: str | None = "target") -> DataFrame:
    """Project one side (0 left, 1 right) onto the unified names."""
    require_columns(df, [m[side] for m in mapping], "source")
    extra = [F.col(target)] if target else []
    return df.select(*[F.col(f"`{m[side]}`").alias(m[2]) for m in mapping], *extra)


def aligned_source(
    features: DataFrame, mapping: Sequence[tuple[str, str, str]], side: int, label: str, labels: Mapping[str, int]
) -> DataFrame:
    """Clean the features, encode the label and project."""
    encoded = encode_labels(features, label, labels)
    cleaned = minimal_clean(encoded.drop(label))
    return aligned(cleaned, mapping, side)


def dropped(catalogue: DataFrame, kept: DataFrame) -> DataFrame:
    """Columns that are not part of the shared table."""
    return catalogue.join(kept, "column", "left_anti").select("column", F.lit(DROPPED_REASON).alias("reason"))


def join_target(features: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Features and targets of the same rows."""
    return features.join(targets, key)
