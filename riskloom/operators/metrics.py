"""Discrimination, calibration and threshold metrics of binary predictions.

A prediction table has a truth column (0/1), a predicted label (0/1) and a score,
plus grouping columns such as the model, the split or the fold. Everything is
computed from one aggregate by (group, score), so rows are shuffled only as
partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed import METRICS
from riskloom.operators.ranking import range_cuts, running_totals

TRUTH, LABEL, SCORE = "target_true", "prediction_label", "risk_score"


def ratio(part: Column, whole: Column, otherwise: Column | None = None) -> Column:
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if otherwise is None else F.coalesce(value, otherwise)


def whole(count: str) -> Column:
    """Group total of a count after `running_totals`.

    It equals the sum over the rows. Asking the range totals as well makes both
    branches of that plan need the same columns, so they share one shuffle.
    """
    return F.greatest(F.sum(count), F.max(f"total_{count}"))


def score_cells(
    predictions: DataFrame, groups: Sequence[str], weight: str | None = None, label: str | None = LABEL
) -> DataFrame:
    """Counts per (group, score): positives, negatives and the correct ones of each.

    A row without a score can't be ordered: the job fails with a message.
    """
    unit = F.lit(1) if weight is None else F.col(weight)

    def tally(condition: Column) -> Column:
        return F.sum(F.when(condition, unit).otherwise(F.lit(0))).cast("long")

    positive = F.col(TRUTH) == 1
    parts = [tally(positive).alias("pos"), tally(~positive).alias("neg")]
    if label is not None:
        parts += [
            tally(positive & (F.col(label) == 1)).alias("tp"),
            tally(~positive & (F.col(label) == 1)).alias("fp"),
        ]
    missing = F.raise_error(F.lit("a prediction has no score")).cast(predictions.schema[SCORE].dataType)
    return predictions.groupBy(*groups, F.coalesce(F.col(SCORE), missing).alias(SCORE)).agg(*parts)


def threshold_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates from the four cells; 0 for an empty denominator, missing for specificity."""
    zero = F.lit(0.0)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp, zero),
        "recall_sensitivity": ratio(tp, tp + fn, zero),
        "specificity": ratio(tn, tn + fp),
        "f1_score": ratio(tp * 2, tp * 2 + fp + fn, zero),
    }


def metric_table(
    predictions: DataFrame,
    groups: Sequence[str],
    weight: str | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """The eight metrics, one row per group."""
    cuts = range_cuts(predictions, SCORE) if cuts is None else cuts
    cells = score_cells(predictions, groups, weight)
    ordered = running_totals(cells, groups, SCORE, ["pos", "neg", "tp", "fp"], cuts)

    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    all_pos, all_neg = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    pos_from = all_pos - F.col("before_pos")
    rows_from = all_pos + all_neg - F.col("before_pos") - F.col("before_neg")
    score = F.col(SCORE)

    sums = ordered.groupBy(*groups).agg(
        *[whole(c).alias(n) for c, n in (("pos", "n_positive"), ("neg", "n_negative"), ("tp", "tp"), ("fp", "fp"))],
        F.sum(pos * (F.col("before_neg") + neg / 2)).alias("_wins"),
        F.sum(F.when(pos > 0, F.try_divide(pos, all_pos) * F.try_divide(pos_from, rows_from))).alias("auprc"),
        F.sum(pos * (score - 1) * (score - 1) + neg * score * score).alias("_squares"),
    )
    fn = F.col("n_positive") - F.col("tp")
    tn = F.col("n_negative") - F.col("fp")
    rates = threshold_metrics(F.col("tp"), F.col("fp"), fn, tn)
    rates["auroc"] = ratio(F.col("_wins"), F.col("n_positive").cast("double") * F.col("n_negative").cast("double"))
    rates["auprc"] = F.col("auprc")
    rates["brier_score"] = ratio(F.col("_squares"), F.col("n_positive") + F.col("n_negative"))
    return sums.select(
        *groups,
        (F.col("n_positive") + F.col("n_negative")).alias("n_rows"),
        "n_positive",
        "n_negative",
        *[rates[m].alias(m) for m in METRICS],
    )


def auroc(predictions: DataFrame, groups: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """Area under the ROC curve only; no predicted label needed."""
    cuts = range_cuts(predictions, SCORE) if cuts is None else cuts
    cells = score_cells(predictions, groups, label=None)
    ordered = running_totals(cells, groups, SCORE, ["pos", "neg"], cuts)
    wins = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2))
    return ordered.groupBy(*groups).agg(
        whole("pos").alias("n_positive"),
        whole("neg").alias("n_negative"),
        F.count(F.lit(1)).alias("distinct_scores"),
        ratio(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auroc"),
    )


def confusion(predictions: DataFrame, groups: Sequence[str]) -> DataFrame:
    """All four cells of the 2 x 2 table, zero where nothing was observed."""

    def cell(truth: int, label: int) -> Column:
        return F.count_if((F.col(TRUTH) == truth) & (F.col(LABEL) == label))

    wide = predictions.groupBy(*groups).agg(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("target_true"), F.lit(p).alias("prediction_label"), cell(t, p).alias("row_count")
                )
                for t in (0, 1)
                for p in (0, 1)
            ]
        ).alias("_cells")
    )
    return wide.select(*groups, F.inline("_cells"))


def curve_points(predictions: DataFrame, groups: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """ROC and precision-recall points, one per distinct score used as a threshold."""
    cuts = range_cuts(predictions, SCORE) if cuts is None else cuts
    cells = score_cells(predictions, groups, label=None)
    ordered = running_totals(cells, groups, SCORE, ["pos", "neg"], cuts)
    tp = F.col("total_pos") - F.col("before_pos")
    fp = F.col("total_neg") - F.col("before_neg")
    return ordered.select(
        *groups,
        F.col(SCORE).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        ratio(tp, F.col("total_pos")).alias("tpr"),
        ratio(fp, F.col("total_neg")).alias("fpr"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("total_pos")).alias("recall"),
    )


def roc_points(predictions: DataFrame, groups: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """ROC points with the starting point (0, 0) at an infinite threshold."""
    points = curve_points(predictions, groups, cuts).select(*groups, "fpr", "tpr", "threshold")
    start = predictions.select(*groups).distinct().select(
        *groups, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return start.unionByName(points)


def pr_points(predictions: DataFrame, groups: Sequence[str], cuts: Sequence[float] | None = None) -> DataFrame:
    """Precision-recall points with the end point (recall 0, precision 1), which has no threshold."""
    points = curve_points(predictions, groups, cuts).select(*groups, "precision", "recall", "threshold")
    end = predictions.select(*groups).distinct().select(
        *groups, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return end.unionByName(points)


def calibration(predictions: DataFrame, groups: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean score and positive share in equal-width score bins; empty bins are absent."""
    position = F.greatest(F.ceil(F.col(SCORE) * bins) - 1, F.lit(0))
    return (
        predictions.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy(*groups, "bin")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg(F.col(TRUTH).cast("double")).alias("positive_share"),
            F.avg(SCORE).alias("mean_score"),
        )
    )


def fold_summary(fold_metrics: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and sample deviation over folds; missing folds are ignored, one fold has deviation 0."""
    parts = [F.count(F.lit(1)).alias("cv_fold_count")]
    for m in metrics:
        parts.append(F.avg(m).alias(f"{m}_mean"))
        parts.append(F.when(F.count(F.lit(1)) == 1, F.lit(0.0)).otherwise(F.stddev_samp(m)).alias(f"{m}_std"))
    return fold_metrics.groupBy(*keys).agg(*parts)


def long_metrics(table: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    return table.unpivot(list(keys), list(metrics), "metric", "value")


def best_by(table: DataFrame, ordering: Sequence[Column], keep: Sequence[str] = ("*",)) -> DataFrame:
    """The first row under an explicit ordering, ties included in the ordering."""
    return table.orderBy(*ordering).limit(1).select(*keep)


def compare_to_reference(table: DataFrame, name: str, reference: str, metrics: Sequence[str]) -> DataFrame:
    """Differences of every other model to one model."""
    one = F.broadcast(
        table.filter(F.col(name) == reference)
        .limit(1)
        .select(F.lit(True).alias("_one"), F.col(name).alias("compared_model"), *[F.col(m).alias(f"compared_{m}") for m in metrics])
    )
    others = table.filter(F.col(name) != reference).withColumn("_one", F.lit(True))
    return others.join(one, "_one").select(
        F.col(name).alias("baseline_model"),
        "compared_model",
        *[
            c
            for m in metrics
            for c in (
                F.col(m).alias(f"baseline_{m}"),
                F.col(f"compared_{m}"),
                (F.col(f"compared_{m}") - F.col(m)).alias(f"{m}_difference"),
            )
        ],
    )
