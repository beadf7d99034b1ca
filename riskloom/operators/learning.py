"""Imputation, encoding, classifiers, cross-validation and search on Spark ML.

Every fitted step is a Spark ML stage, so a whole model is one `PipelineModel`
that can be saved, loaded and run on a batch or a stream.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from hashlib import md5
from itertools import product
from math import gcd

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VarianceThresholdSelector,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from riskloom.fixed import METRICS, SEED
from riskloom.operators.boosting import BoostSetting, HistogramBoosting
from riskloom.operators.inference import MODEL, ROW
from riskloom.operators.metrics import LABEL, SCORE, TRUTH, auroc, best_by, fold_summary, metric_table
from riskloom.operators.monitor import exact_quantiles
from riskloom.operators.ranking import range_cuts, running_totals
from riskloom.session import checkpoint

INDEXED, ENCODED, RAW, VECTOR = "_index", "_onehot", "_raw", "features"
#: Fits that run at once; each is a chain of small jobs or one task, which leaves most cores idle.
FITS = 6


def side_by_side(spark: SparkSession, calls: Sequence[Callable[[], object]]) -> list:
    """Results of independent calls in their order, `FITS` of them at once."""
    if len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(FITS) as pool:
        return [found.result() for found in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of all columns in one ordered pass; one number per column reaches the driver."""
    if not columns:
        return {}
    cells = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "column", "value")
    rows = exact_quantiles(cells, ["column"], "value", {"median": 0.5}).collect()
    return {r["column"]: r["median"] for r in rows}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent text of every column, the smallest one on a tie."""
    if not columns:
        return {}
    cells = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], list(columns), "column", "value")
    counts = cells.filter("value is not null").groupBy("column", "value").agg((-F.count(F.lit(1))).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct("n", "value"))["value"].alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def _quoted(value: str | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{float(value)!r}D"


def _projection(replacements: Mapping[str, str]) -> SQLTransformer:
    """Stage that adds or replaces columns and keeps all others."""
    names = ", ".join(f"`{c}`" for c in replacements)
    added = ", ".join(f"{e} AS `{c}`" for c, e in replacements.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({names}), {added} FROM __THIS__")


def fill_stage(values: Mapping[str, str | float], numeric: bool) -> SQLTransformer:
    cast = "DOUBLE" if numeric else "STRING"
    return _projection({c: f"coalesce(CAST(`{c}` AS {cast}), {_quoted(v)})" for c, v in values.items()})


def fill_by_median(df: DataFrame, columns: Sequence[str]) -> list[Transformer]:
    found = medians(df, columns)
    return [fill_stage({c: found.get(c, 0.0) for c in columns}, True)] if columns else []


def fill_by_mode(df: DataFrame, columns: Sequence[str]) -> list[Transformer]:
    found = modes(df, columns)
    return [fill_stage({c: found.get(c, "") for c in columns}, False)] if columns else []


def fill_by_regression(df: DataFrame, columns: Sequence[str], rounds: int = 2, row_key: str | None = None) -> list[Transformer]:
    """Chained equations: start from means, then regress every incomplete column on the others, round by round.

    A guess is linear in the values of its row, so all fits follow from the sums
    of products of the observed values, per pattern of missing cells. They come
    from two passes over the table, whatever the number of rounds and columns.
    """
    if not columns:
        return []
    facts = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
    ).first()
    means = {c: facts[f"m_{c}"] if facts[f"m_{c}"] is not None else 0.0 for c in columns}
    incomplete = [c for c in columns if facts[f"n_{c}"] > 0]
    flags = _projection_added({f"_gap_{c}": f"`{c}` IS NULL" for c in columns})
    stages: list[Transformer] = [flags, fill_stage(means, True)]
    if incomplete and rounds and len(columns) > 1:
        chain = Chain(columns, product_sums(df, columns, means))
        for _ in range(rounds):
            for c in incomplete:
                constant, weights = chain.fit(columns.index(c))
                terms = " + ".join(f"{_quoted(w)} * (`{o}` - {_quoted(means[o])})" for o, w in zip(columns, weights) if o != c)
                guess = f"{_quoted(means[c] + constant)} + {terms}"
                stages.append(_projection({c: f"CASE WHEN `_gap_{c}` THEN {guess} ELSE `{c}` END"}))
    names = ", ".join(f"`_gap_{c}`" for c in columns)
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({names}) FROM __THIS__"))
    return stages


def product_sums(df: DataFrame, columns: Sequence[str], means: Mapping[str, float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each pattern of missing cells: which columns are there, and the sums of products of 1 and the centred values.

    One aggregate; a row per pattern that occurs reaches the driver.
    """
    there = [F.col(f"`{c}`").isNotNull() for c in columns]
    values = [F.lit(1.0), *[F.coalesce(F.col(f"`{c}`").cast("double") - F.lit(means[c]), F.lit(0.0)) for c in columns]]
    size = len(values)
    cells = [(i, j) for i in range(size) for j in range(i + 1)]
    staged = df.select(F.array(*there).alias("there"), *[v.alias(f"v{i}") for i, v in enumerate(values)])
    rows = staged.groupBy("there").agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in cells]).collect()
    out = []
    for row in rows:
        products = np.zeros((size, size))
        for i, j in cells:
            products[i, j] = products[j, i] = row[f"s{i}_{j}"]
        out.append((np.array(row["there"], bool), products))
    return out


class Chain:
    """Current guesses of all patterns, as linear forms in 1 and the observed values, all centred."""

    def __init__(self, columns: Sequence[str], patterns: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.patterns = patterns
        self.forms = [np.diag([1.0, *there.astype(float)]) for there, _ in patterns]

    def fit(self, column: int) -> tuple[float, np.ndarray]:
        """Regress a column on the others where it is there, and renew its guesses where it is not."""
        at, size = column + 1, len(self.forms[0])
        total = np.zeros((size, size))
        for (there, products), form in zip(self.patterns, self.forms):
            if there[column]:
                total += form @ products @ form.T
        others = [i for i in range(size) if i != at]
        scale = np.sqrt(np.maximum(np.diag(total), 1e-300))
        even = total / np.outer(scale, scale)
        found = np.linalg.lstsq(even[np.ix_(others, others)], even[others, at], rcond=1e-12)[0] * scale[at] / scale[others]
        weights = np.zeros(size)
        weights[others] = np.where(np.diag(total)[others] > 0, found, 0.0)
        for (there, _), form in zip(self.patterns, self.forms):
            if not there[column]:
                form[at] = weights @ form
        return float(weights[0]), weights[1:]


def _projection_added(columns: Mapping[str, str]) -> SQLTransformer:
    added = ", ".join(f"{e} AS `{c}`" for c, e in columns.items())
    return SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__")


IMPUTERS: dict[str, Callable[[DataFrame, Sequence[str]], list[Transformer]]] = {
    "median": fill_by_median,
    "ice": fill_by_regression,
}


def encode_stages(text: Sequence[str]) -> list:
    """Codes and one-hot slots; a category that training never saw becomes all zeros."""
    if not text:
        return []
    index = [f"{c}{INDEXED}" for c in text]
    return [
        StringIndexer(inputCols=list(text), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=[f"{c}{ENCODED}" for c in text], dropLast=True),
    ]


def keep_columns(vectors: DataFrame, column: str, limit: float = 0.95) -> list[int]:
    """Vector slots to keep so that no pair is correlated above a limit.

    The correlation matrix has one cell per pair of columns and does not grow
    with the rows. A constant slot has no correlation and stays.
    """
    matrix = Correlation.corr(vectors, column).head()[0].toArray()
    kept: list[int] = []
    for i in range(matrix.shape[0]):
        if all(not abs(matrix[i, j]) > limit for j in kept):
            kept.append(i)
    return kept


@dataclass(frozen=True)
class ModelSpec:
    """What a candidate pipeline is made of."""

    name: str
    classifier: Callable[[], object]
    imputer: str = "median"
    scaling: str = "nop"
    selection: str = "nop"
    label: str = ""


def logistic_regression(penalty: float = 1e-4):
    return LogisticRegression(maxIter=1000, regParam=penalty, featuresCol=VECTOR, labelCol=TRUTH)


def random_forest(trees: int = 300, depth: int = 5):
    return lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featuresCol=VECTOR, labelCol=TRUTH)


def gradient_boosting(rounds: int = 300, step: float = 0.05, depth: int = 4):
    return lambda: HistogramBoosting(BoostSetting(rounds, step, depth), featuresCol=VECTOR, labelCol=TRUTH)


def baseline_specs(trees: int = 300, rounds: int = 300) -> list[ModelSpec]:
    return [
        ModelSpec("logistic_regression", logistic_regression, label="LogisticRegression"),
        ModelSpec("random_forest", random_forest(trees), label="RandomForestClassifier"),
        ModelSpec("gradient_boosting", gradient_boosting(rounds), label="HistogramBoosting"),
    ]


def fit_preparation(train: DataFrame, spec: ModelSpec, numeric: Sequence[str], text: Sequence[str]) -> PipelineModel:
    """Impute, encode and assemble; then scale and drop columns when the spec asks for it."""
    stages: list = [*IMPUTERS[spec.imputer](train, numeric), *fill_by_mode(train, text), *encode_stages(text)]
    stages.append(
        VectorAssembler(inputCols=[*numeric, *[f"{c}{ENCODED}" for c in text]], outputCol=RAW, handleInvalid="error")
    )
    column = RAW
    if spec.scaling == "standard":
        stages.append(StandardScaler(inputCol=column, outputCol="_scaled", withMean=False, withStd=True))
        column = "_scaled"
    if spec.selection in ("variance", "cleanup"):
        stages.append(VarianceThresholdSelector(featuresCol=column, outputCol="_varying", varianceThreshold=1e-8))
        column = "_varying"
    prepared = Pipeline(stages=stages).fit(train)
    if spec.selection == "cleanup":
        slots = keep_columns(prepared.transform(train).select(column), column)
        last = VectorSlicer(inputCol=column, outputCol=VECTOR, indices=slots)
    else:
        last = VectorAssembler(inputCols=[column], outputCol=VECTOR)
    return PipelineModel([*prepared.stages, last])


def fit_all(
    train: DataFrame, specs: Sequence[ModelSpec], numeric: Sequence[str], text: Sequence[str]
) -> dict[str, PipelineModel]:
    """Models that take raw columns; the target column is `target_true`.

    Specs with the same preparation share it and its prepared table, which is
    kept while their classifiers iterate over it.
    """
    models, groups = {}, {}
    for spec in specs:
        groups.setdefault((spec.imputer, spec.scaling, spec.selection), []).append(spec)
    for members in groups.values():
        preparation = fit_preparation(train, members[0], numeric, text)
        prepared = preparation.transform(train).select(TRUTH, VECTOR).persist(StorageLevel.MEMORY_AND_DISK)
        found = side_by_side(train.sparkSession, [lambda spec=spec: spec.classifier().fit(prepared) for spec in members])
        models.update({spec.name: PipelineModel([*preparation.stages, model]) for spec, model in zip(members, found)})
        prepared.unpersist()
    return models


def fit(train: DataFrame, spec: ModelSpec, numeric: Sequence[str], text: Sequence[str]) -> PipelineModel:
    return fit_all(train, [spec], numeric, text)[spec.name]


def positive_probability():
    return vector_to_array(F.col("probability"))[1]


def predict(model: PipelineModel, df: DataFrame, row_key: str, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prediction table of a fitted model."""
    return model.transform(df).select(
        F.col(row_key).alias(ROW),
        *keep,
        F.lit(name).alias(MODEL),
        F.col(TRUTH),
        F.col("prediction").cast("int").alias(LABEL),
        positive_probability().alias(SCORE),
    )


def cross_validate(
    df: DataFrame, specs: Sequence[ModelSpec], numeric: Sequence[str], text: Sequence[str], row_key: str, folds: int
) -> DataFrame:
    """Out-of-fold predictions of all specs as one table; `df` has a `fold` column. The folds are fitted side by side."""
    parts = []
    fits = [lambda k=k: fit_all(df.filter(F.col("fold") != k), specs, numeric, text) for k in range(folds)]
    for k, models in enumerate(side_by_side(df.sparkSession, fits)):
        held_out = df.filter(F.col("fold") == k)
        parts += [predict(models[s.name], held_out, row_key, s.name, ["fold"]) for s in specs]
    return union_all(parts)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_baselines(
    train: DataFrame,
    test: DataFrame,
    specs: Sequence[ModelSpec],
    numeric: Sequence[str],
    text: Sequence[str],
    row_key: str,
    folds: int,
) -> tuple[DataFrame, DataFrame, dict[str, PipelineModel]]:
    """CV summary, held-out predictions and refitted models of all specs."""
    models = fit_all(train, specs, numeric, text)
    held_out = union_all([predict(models[s.name], test, row_key, s.name) for s in specs])
    per_fold = metric_table(cross_validate(train, specs, numeric, text, row_key, folds), [MODEL, "fold"])
    order = F.array_position(F.array(*[F.lit(s.name) for s in specs]), F.col(MODEL)).cast("int")
    summary = fold_summary(per_fold, [MODEL]).withColumn("model_order", order)
    return summary, held_out, models


def select_best(cv: DataFrame, held_out_metrics: DataFrame) -> DataFrame:
    """Best model by mean CV AUROC, the first listed on a tie, with its held-out metrics."""
    best = best_by(cv, [F.desc_nulls_last("auroc_mean"), F.asc("model_order")], [MODEL, "auroc_mean"])
    tested = held_out_metrics.select(MODEL, *[F.col(m).alias(f"test_{m}") for m in METRICS])
    return best.join(tested, MODEL).withColumn("selection_metric", F.lit("cv_mean_auroc"))


def best_record(best: DataFrame, specs: Sequence[ModelSpec], pointers: Mapping[str, str]) -> DataFrame:
    """The best model's row with its estimator's label and where its artefacts lie, one column per pointer."""
    labels = [F.when(F.col(MODEL) == s.name, s.label or s.name) for s in specs]
    return best.withColumns({"best_estimator_label": F.coalesce(*labels), **{name: F.lit(path) for name, path in pointers.items()}})


@dataclass
class SearchSpace:
    """Axes of the pipeline search."""

    classifiers: Mapping[str, Callable[[], object] | Drawn]
    imputers: Sequence[str] = ("ice",)
    scaling: Sequence[str] = ("nop",)
    selection: Sequence[str] = ("nop",)
    time_budget: float = 300.0
    score_threshold: float = 0.5
    ensemble_size: int = 1


@dataclass
class SearchResult:
    """Tried candidates in order with the mean score of the folds they saw, and the ensemble; no members when nothing passed."""

    trials: list[tuple[str, float]] = field(default_factory=list)
    members: list[tuple[float, PipelineModel]] = field(default_factory=list)


@dataclass(frozen=True)
class Drawn:
    """A classifier whose settings are drawn: `make` takes one value of each of `choices` and returns a factory."""

    make: Callable[..., Callable[[], object]]
    choices: Mapping[str, Sequence]

    def draw(self, name: str, number: int, seed: int) -> dict:
        """Settings number `number`, the same in every run."""
        places = {key: int(md5(f"{seed}|{name}|{number}|{key}".encode()).hexdigest()[:8], 16) for key in self.choices}
        return {key: values[places[key] % len(values)] for key, values in self.choices.items()}


def candidates(space: SearchSpace, draws: int = 1, seed: int = SEED) -> list[ModelSpec]:
    """Specs of all axes; a classifier with drawn settings comes up to `draws` times, each setting once."""
    made: dict[str, tuple[Callable[[], object], str]] = {}
    for name, classifier in space.classifiers.items():
        if not isinstance(classifier, Drawn):
            made[name] = classifier, name
            continue
        for number in range(draws):
            setting = classifier.draw(name, number, seed)
            made[f"{name}({', '.join(f'{k}={v}' for k, v in setting.items())})"] = classifier.make(**setting), name
    return [
        ModelSpec(f"{c}|{i}|{s}|{x}", factory, i, s, x, label)
        for (c, (factory, label)), i, s, x in product(made.items(), space.imputers, space.scaling, space.selection)
    ]


def search(
    train: DataFrame, space: SearchSpace, numeric: Sequence[str], text: Sequence[str], row_key: str, folds: int, draws: int = 5, keep: int = 3
) -> SearchResult:
    """Try pipelines by cross-validated AUROC and refit the best as a weighted ensemble.

    Successive halving: all candidates are tried on the first fold, the best 1 / `keep` of them on the next ones too, and
    so on until few enough are left for all folds. Candidates of one preparation share it and its table in every fold. Each
    fit is distributed; only scores reach the driver. The time budget ends the trials between two folds, and those that
    have seen the most folds count.
    """
    started, specs = time.monotonic(), candidates(space, draws)
    scores: dict[str, list[float]] = {s.name: [] for s in specs}
    left, out_of_fold, goal = list(specs), [], max(keep, space.ensemble_size)
    for k in range(folds):
        if k and time.monotonic() - started > space.time_budget:
            break
        models = fit_all(train.filter(F.col("fold") != k), left, numeric, text)
        held_out = train.filter(F.col("fold") == k)
        scored = checkpoint(union_all([predict(models[s.name], held_out, row_key, s.name, ["fold"]) for s in left]))
        out_of_fold.append(scored)
        found = {r[MODEL]: r["auroc"] for r in auroc(scored, [MODEL]).collect()}
        for s in left:
            scores[s.name].append(found.get(s.name) or 0.0)
        if len(left) > goal:
            ranked = sorted(left, key=lambda s: -sum(scores[s.name]) / len(scores[s.name]))
            left = ranked[: max(goal, -(-len(left) // keep))]
    result = SearchResult([(s.name, sum(scores[s.name]) / len(scores[s.name])) for s in specs if scores[s.name]])
    means = dict(result.trials)
    passed = sorted((s for s in left if means.get(s.name, 0.0) >= space.score_threshold), key=lambda s: -means[s.name])
    if not passed:
        return result
    weights = ensemble_weights(union_all(out_of_fold), [s.name for s in passed], space.ensemble_size)
    chosen = [s for s in passed if s.name in weights]
    fitted = fit_all(train, chosen, numeric, text)
    result.members = [(weights[s.name], fitted[s.name]) for s in chosen]
    return result


def ensemble_weights(predictions: DataFrame, models: Sequence[str], size: int, rounds: int = 10) -> dict[str, float]:
    """Weights of at most `size` models by greedy selection: each round adds the model whose addition ranks the rows best.

    All rounds are gone through, as one without a gain may lead to a better mix, and the first of the best rounds gives the
    weights. A model may be added again; of equal scores the first one counts. The rows are pivoted once, rows of equal scores
    are counted, and a round is one pass over these cells for all models. All rows count: one that some models did not score
    has the mean of the others picked, and half its pairs are won where none of them scored it. Copies of a row stay apart.
    """
    if len(models) == 1 or size == 1:
        return {models[0]: 1.0}
    columns = [f"m{i}" for i in range(len(models))]
    rows = predictions.where(F.col(MODEL).isin(*models)).withColumn(SCORE, F.nanvl(SCORE, F.lit(None).cast("double"))).repartition(ROW, TRUTH)
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(ROW, TRUTH, MODEL).orderBy(F.asc_nulls_last(SCORE))))
    wide = rows.groupBy(ROW, TRUTH, "_copy").pivot(MODEL, list(models)).agg(F.first(SCORE)).toDF(ROW, TRUTH, "_copy", *columns)
    cells = checkpoint(wide.groupBy(TRUTH, *columns).agg(F.count(F.lit(1)).alias("_rows")))
    classes = [(name, F.coalesce(F.sum(F.when(F.col(TRUTH) == t, F.col("_rows"))), F.lit(0))) for t, name in ((1, "pos"), (0, "neg"))]
    positives, negatives = cells.agg(*[n.alias(name) for name, n in classes]).first()
    pairs = float(positives) * negatives
    if not pairs:
        return {models[0]: 1.0}
    picked, chosen, best = [0] * len(models), [1], -1.0
    for _ in range(rounds):
        tries = {}
        for i in range(len(models)):
            counts = [n + (i == j) for j, n in enumerate(picked)]
            if sum(n > 0 for n in counts) <= size:
                tries[i] = mean_score([(c, n) for c, n in zip(columns, counts) if n])
        mixed = F.array(*[F.struct(F.lit(str(i)).alias(MODEL), score.alias(SCORE)) for i, score in tries.items()])
        trial = cells.select(TRUTH, "_rows", F.inline(mixed)).where(F.col(SCORE).isNotNull())
        sums = trial.groupBy(MODEL, SCORE).agg(*[n.alias(name) for name, n in classes])
        ordered = running_totals(sums, [MODEL], SCORE, ["pos", "neg"], range_cuts(trial, SCORE))
        wins = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2))
        found = ordered.groupBy(MODEL).agg(wins.alias("wins"), (F.sum("pos").cast("double") * F.sum("neg")).alias("ranked")).collect()
        areas = {i: 0.5 for i in tries} | {int(r[MODEL]): (r["wins"] + (pairs - r["ranked"]) / 2) / pairs for r in found}
        top = min(areas, key=lambda i: (-round(areas[i], 12), i))
        picked[top] += 1
        if areas[top] > best + 1e-12:
            chosen, best = list(picked), areas[top]
    return {m: n / sum(chosen) for m, n in zip(models, chosen) if n}


def mean_score(counts: Sequence[tuple[str, int]]) -> Column:
    """Mean of score columns, each taken so many times, over those that have a score; null where none has."""
    part = gcd(*[n for _, n in counts])  # equal mixes have the very same means
    scored = sum((F.when(F.col(c).isNotNull(), n // part).otherwise(0) for c, n in counts), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) * (n // part) for c, n in counts), F.lit(0.0)), scored)


def predict_ensemble(
    members: Sequence[tuple[float, PipelineModel]], df: DataFrame, row_key: str, name: str, threshold: float = 0.5
) -> DataFrame:
    """Weighted mean probability of several models, as added columns of one scan."""
    out = df.withColumn("_score", F.lit(0.0))
    for weight, model in members:
        scored = model.transform(out)
        out = scored.select(*df.columns, (F.col("_score") + F.lit(weight) * positive_probability()).alias("_score"))
    return out.select(
        F.col(row_key).alias(ROW),
        F.lit(name).alias(MODEL),
        F.col(TRUTH),
        (F.col("_score") >= threshold).cast("int").alias(LABEL),
        F.col("_score").alias(SCORE),
    )


@dataclass(frozen=True)
class Bundle:
    """A fitted model with what serving needs: its feature order, which features are numbers, and its version."""

    model: PipelineModel
    features: tuple[str, ...]
    numeric: tuple[str, ...]
    version: str


def fit_bundle(train: DataFrame, spec: ModelSpec, numeric: Sequence[str], text: Sequence[str], version: str) -> Bundle:
    """Model of `spec`; its feature order is that of the columns of `train`.

    Fitting passes over `train` many times, so what it is made from - parsed bodies, say - is worked out once and stored.
    """
    order = tuple(c for c in train.columns if c in {*numeric, *text})
    rows = checkpoint(train.select(TRUTH, *order))
    return Bundle(fit(rows, spec, numeric, text), order, tuple(numeric), version)


def save_bundle(bundle: Bundle, path: str) -> None:
    save(bundle.model, f"{path}/model")
    spark = SparkSession.active()
    rows = [(i, name, name in bundle.numeric, bundle.version) for i, name in enumerate(bundle.features)]
    facts = spark.createDataFrame(rows, "place int, feature string, is_number boolean, version string")
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/features")  # one row per feature


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    schema = "place int, feature string, is_number boolean, version string"
    rows = spark.read.schema(schema).json(f"{path}/features").orderBy("place").collect()
    numeric = tuple(r["feature"] for r in rows if r["is_number"])
    return Bundle(load(f"{path}/model"), tuple(r["feature"] for r in rows), numeric, rows[0]["version"])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
