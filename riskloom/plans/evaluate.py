"""Train, compare and test binary classifiers on one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from riskloom.fixed import FOLDS, REPLICATES, SEED, TEST_SHARE
from riskloom.operators import inference, leakage, learning, metrics, profile, split
from riskloom.operators.contracts import prediction_misalignment, require_binary, require_empty
from riskloom.operators.inference import MODEL, ROW
from riskloom.operators.metrics import TRUTH


@dataclass
class Evaluation:
    """Tables and models of one comparison."""

    split: DataFrame
    split_check: DataFrame
    leakage: DataFrame
    screen: DataFrame
    cv: DataFrame
    predictions: DataFrame
    test_metrics: DataFrame
    best: DataFrame
    models: dict[str, PipelineModel]


def evaluate(
    df: DataFrame,
    row_key: str,
    target: str,
    specs: Sequence[learning.ModelSpec] | None = None,
    folds: int = FOLDS,
    share: float = TEST_SHARE,
    seed: int = SEED,
) -> Evaluation:
    """Validate, split, cross-validate, refit and score every spec on the same split."""
    require_binary(df, target)
    specs = learning.baseline_specs() if specs is None else list(specs)
    numeric, text = profile.feature_lists(df, target, (row_key,))
    parts = split.stratified_split(df, row_key, target, share, seed)
    named = parts.withColumnRenamed(target, TRUTH)
    train = split.stratified_folds(named.filter("split = 'train'").drop("split"), row_key, TRUTH, folds, seed).persist()
    test = named.filter("split = 'test'").drop("split")
    cv, predictions, models = learning.run_baselines(train, test, specs, numeric, text, row_key, folds)
    tested = metrics.metric_table(predictions, [MODEL])
    table = split.split_table(parts, row_key, target)
    return Evaluation(
        split=table,
        split_check=split.split_check(df, row_key, table),
        leakage=split.split_leakage(parts, row_key, [*numeric, *text]),
        screen=leakage.feature_screen(parts, target, skip=[row_key]),
        cv=cv,
        predictions=predictions,
        test_metrics=tested,
        best=learning.select_best(cv, tested),
        models=models,
    )


def significance(
    predictions: DataFrame, models: Sequence[str], replicates: int = REPLICATES, seed: int = SEED
) -> dict[str, DataFrame]:
    """Intervals and paired tests; every model must cover the same rows."""
    require_empty(prediction_misalignment(predictions, ROW, MODEL, models), "Prediction rows do not align")
    intervals = inference.bootstrap_intervals(predictions, replicates, seed)
    return {
        "intervals": intervals,
        "wide_intervals": inference.wide_intervals(intervals),
        "delong": inference.delong(predictions, models),
        "mcnemar": inference.mcnemar(predictions, models),
    }
