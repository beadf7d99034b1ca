"""Checks that stop a job before it produces a wrong table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.fixed import REQUIRED_MODEL_FIELDS, STATUSES


class ContractError(ValueError):
    """A table does not satisfy what the next step relies on."""


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    """Schema check only; no job runs."""
    present = set(df.columns)
    missing = sorted(c for c in columns if c not in present)
    if missing:
        raise ContractError(f"{name} is missing required columns: {missing}")
    return df


def target_domain(df: DataFrame, target: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts that tell whether a target holds exactly the classes 0 and 1."""
    value = F.col(target)
    counts = df.groupBy(*groups).agg(
        F.count_if(value == 0).alias("zeros"),
        F.count_if(value == 1).alias("ones"),
        F.count_if(value.isNotNull() & ~value.isin(0, 1)).alias("others"),
        F.count_if(value.isNull()).alias("missing"),
    )
    return counts.withColumn("is_binary", (F.col("zeros") > 0) & (F.col("ones") > 0) & (F.col("others") == 0))


def require_binary(df: DataFrame, target: str) -> DataFrame:
    row = target_domain(df, target).first()
    if not row["is_binary"]:
        raise ContractError(f"Target {target} must contain only 0 and 1, found {row.asDict()}")
    return df


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with up to ten example rows when a violations table has rows."""
    examples = violations.limit(10).collect()
    if examples:
        raise ContractError(f"{message}: {[r.asDict() for r in examples]}")


def mapping_violations(mapping: DataFrame, left: str, right: str, unified: str = "unified_name") -> DataFrame:
    """Reasons why the rows kept for the shared model may not be used yet."""
    keep = F.lower(F.trim("keep_for_shared_model")) == "yes"
    kept = mapping.filter(keep)
    review = kept.filter(F.lower(F.trim("manual_review_required")) == "yes").select(
        F.lit("open_review").alias("violation"), F.col(unified).alias("detail")
    )
    blanks = [
        kept.filter(F.coalesce(F.trim(c), F.lit("")) == "").select(
            F.lit(f"blank_{c}").alias("violation"), F.coalesce(F.col(unified), F.lit("")).alias("detail")
        )
        for c in (left, right, unified)
    ]
    repeats = [
        kept.groupBy(c)
        .count()
        .filter("count > 1")
        .select(F.lit(f"duplicate_{c}").alias("violation"), F.col(c).alias("detail"))
        for c in (left, right, unified)
    ]
    out = review
    for part in (*blanks, *repeats):
        out = out.unionByName(part)
    return out


def prediction_misalignment(predictions: DataFrame, key: str, model: str, models: Sequence[str]) -> DataFrame:
    """Rows that some model lacks, repeats or sees with another truth value."""
    per_row = predictions.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(model).alias("model_count"),
        F.min("target_true").alias("lowest_truth"),
        F.max("target_true").alias("highest_truth"),
    )
    n = len(models)
    aligned = (
        (F.col("row_count") == n) & (F.col("model_count") == n) & F.col("lowest_truth").eqNullSafe(F.col("highest_truth"))
    )
    return per_row.filter(~aligned)


def status_violations(models: DataFrame) -> DataFrame:
    """Registry rows with an unknown status or without a required field."""
    bad = ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    for field in REQUIRED_MODEL_FIELDS:
        bad = bad | F.col(field).isNull()
    return models.filter(bad)


def unknown_active(active: DataFrame, models: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Active ids that no registry row carries."""
    return active.join(models.select(*keys), list(keys), "left_anti")
