"""Bootstrap intervals and paired tests of prediction tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskloom.fixed import CONFIDENCE, METRICS, REPLICATES, SEED, SIGNIFICANCE
from riskloom.functions.stats import exact_mcnemar, normal_two_sided
from riskloom.operators.bootstrap import bootstrap_metrics
from riskloom.operators.metrics import LABEL, SCORE, TRUTH, metric_table, score_cells
from riskloom.operators.ranking import range_cuts, running_totals, spread_lookup

MODEL, ROW = "model_name", "row_index"


def bootstrap_intervals(
    predictions: DataFrame,
    replicates: int = REPLICATES,
    seed: int = SEED,
    confidence: float = CONFIDENCE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Point estimate and percentile interval per model and metric.

    A group of the percentile has one value per replicate, so its size is the
    replicate count and not the row count.
    """
    tail = (1.0 - confidence) / 2.0
    point = metric_table(predictions, [MODEL, *keep]).unpivot([MODEL, *keep], list(METRICS), "metric", "point_estimate")
    spread = (
        bootstrap_metrics(predictions, replicates, seed)
        .unpivot([MODEL, "replicate"], list(METRICS), "metric", "value")
        .groupBy(MODEL, "metric")
        .agg(F.percentile("value", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("_bounds"))
    )
    return point.join(spread, [MODEL, "metric"]).select(
        MODEL,
        *keep,
        "metric",
        "point_estimate",
        F.col("_bounds")[0].alias("ci_lower"),
        F.col("_bounds")[1].alias("ci_upper"),
        F.lit(replicates).alias("n_bootstrap"),
        F.lit(confidence).alias("alpha"),
        F.lit("stratified_percentile").alias("bootstrap_method"),
    )


def interval_text(point, lower, upper):
    return F.format_string("%.3f (%.3f-%.3f)", point, lower, upper)


def wide_intervals(intervals: DataFrame, keys: Sequence[str] = (MODEL,)) -> DataFrame:
    """One row per model with point, bounds and text of every metric."""
    text = interval_text(F.col("point_estimate"), F.col("ci_lower"), F.col("ci_upper"))
    pivoted = (
        intervals.groupBy(*keys)
        .pivot("metric", list(METRICS))
        .agg(
            F.first("point_estimate").alias("point"),
            F.first("ci_lower").alias("ci_lower"),
            F.first("ci_upper").alias("ci_upper"),
            F.first(text).alias("with_ci"),
        )
    )
    return pivoted.select(*[F.col(c).alias(c.removesuffix("_point")) for c in pivoted.columns])


def bonferroni(tests: DataFrame, family: Sequence[str] = (), level: float = SIGNIFICANCE) -> DataFrame:
    """Adjusted p-value inside each test family; a family is a list of model pairs."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*(family or [F.lit(1)])))
    adjusted = F.least(F.col("p_value_raw") * size, F.lit(1.0))
    return tests.withColumn("p_value_bonferroni", adjusted).withColumn(
        "reject_bonferroni", F.col("p_value_bonferroni") < level
    )


def _pairs(models: Sequence[str]) -> list[tuple[int, int]]:
    return list(combinations(range(len(models)), 2))


def delong_components(predictions: DataFrame) -> DataFrame:
    """Placement value of every row for every model (share of the other class it beats)."""
    cuts = range_cuts(predictions, SCORE)
    cells = score_cells(predictions, [MODEL], label=None)
    ordered = running_totals(cells, [MODEL], SCORE, ["pos", "neg"], cuts)
    table = ordered.select(
        MODEL,
        SCORE,
        (F.col("pos") + F.col("neg")).alias("_weight"),
        F.try_divide(F.col("before_neg") + F.col("neg") / 2, F.col("total_neg")).alias("_if_pos"),
        (1 - F.try_divide(F.col("before_pos") + F.col("pos") / 2, F.col("total_pos"))).alias("_if_neg"),
    )
    rows = spread_lookup(predictions.select(ROW, MODEL, TRUTH, SCORE), table, [MODEL, SCORE], "_weight", ROW)
    return rows.select(ROW, MODEL, TRUTH, F.when(F.col(TRUTH) == 1, F.col("_if_pos")).otherwise(F.col("_if_neg")).alias("v"))


def delong(predictions: DataFrame, models: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """Paired AUROC tests of all model pairs, from one pass over one row per case."""
    columns = [f"m{i}" for i in range(len(models))]
    pivoted = delong_components(predictions).groupBy(ROW, TRUTH).pivot(MODEL, list(models)).agg(F.first("v"))
    wide = pivoted.toDF(ROW, TRUTH, *columns)
    positive = F.col(TRUTH) == 1
    entries = [F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n")]
    for i, j in _pairs(models):
        gap = F.col(columns[i]) - F.col(columns[j])
        entries += [
            F.var_samp(F.when(positive, gap)).alias(f"_vp_{i}_{j}"),
            F.var_samp(F.when(~positive, gap)).alias(f"_vn_{i}_{j}"),
        ]
    entries += [F.avg(F.when(positive, F.col(c))).alias(f"_auc_{i}") for i, c in enumerate(columns)]
    sums = wide.agg(*entries)
    pairs = F.array(
        *[
            F.struct(
                F.lit(models[i]).alias("model_a"),
                F.lit(models[j]).alias("model_b"),
                F.lit(_label(models[i], models[j], names)).alias("comparison_label"),
                F.col(f"_auc_{i}").alias("auc_model_a"),
                F.col(f"_auc_{j}").alias("auc_model_b"),
                (
                    F.try_divide(F.col(f"_vp_{i}_{j}"), F.col("_p")) + F.try_divide(F.col(f"_vn_{i}_{j}"), F.col("_n"))
                ).alias("variance"),
            )
            for i, j in _pairs(models)
        ]
    )
    tests = sums.select(F.inline(pairs)).withColumn("auc_diff", F.col("auc_model_a") - F.col("auc_model_b"))
    equal = F.abs("auc_diff") <= 1e-8
    degenerate = F.coalesce(F.col("variance") <= 0, F.lit(True)) | F.isnan("variance")
    z = (
        F.when(degenerate & equal, F.lit(0.0))
        .when(degenerate, F.lit(float("inf")))
        .otherwise(F.try_divide(F.abs("auc_diff"), F.sqrt("variance")))
    )
    return bonferroni(tests.withColumn("z_score", z).withColumn("p_value_raw", normal_two_sided("z_score")))


def _label(a: str, b: str, names: dict[str, str] | None) -> str:
    names = names or {}
    return f"{names.get(a, a)} vs {names.get(b, b)}"


def mcnemar(predictions: DataFrame, models: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """Exact paired tests of correctness for all model pairs, from one pass over one row per case."""
    correct = predictions.select(ROW, MODEL, (F.col(LABEL) == F.col(TRUTH)).alias("c"))
    columns = [f"m{i}" for i in range(len(models))]
    wide = correct.groupBy(ROW).pivot(MODEL, list(models)).agg(F.first("c")).toDF(ROW, *columns)

    def cell(i: int, j: int, a: bool, b: bool):
        return F.count_if((F.col(columns[i]) == a) & (F.col(columns[j]) == b))

    sums = wide.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(models[i]).alias("model_a"),
                    F.lit(models[j]).alias("model_b"),
                    F.lit(_label(models[i], models[j], names)).alias("comparison_label"),
                    cell(i, j, True, True).alias("both_correct"),
                    cell(i, j, True, False).alias("a_correct_b_wrong"),
                    cell(i, j, False, True).alias("a_wrong_b_correct"),
                    cell(i, j, False, False).alias("both_wrong"),
                )
                for i, j in _pairs(models)
            ]
        ).alias("_pairs"),
    )
    rows = F.col("_rows")
    b, c = F.col("a_correct_b_wrong"), F.col("a_wrong_b_correct")
    tests = sums.select("_rows", F.inline("_pairs")).select(
        "model_a",
        "model_b",
        "comparison_label",
        F.try_divide(F.col("both_correct") + b, rows).alias("accuracy_model_a"),
        F.try_divide(F.col("both_correct") + c, rows).alias("accuracy_model_b"),
        F.try_divide(b - c, rows).alias("accuracy_diff"),
        "both_correct",
        "a_correct_b_wrong",
        "a_wrong_b_correct",
        "both_wrong",
        (b + c).alias("discordant_total"),
        F.least(b, c).cast("double").alias("statistic"),
    )
    return bonferroni(tests.withColumn("p_value_raw", exact_mcnemar("a_correct_b_wrong", "a_wrong_b_correct")))
