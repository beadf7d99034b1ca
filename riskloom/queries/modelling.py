"""Imputation, models and streams. Results of iterative fits have no SQL; the others do."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.fixed import FOLDS
from riskloom.operators import boosting, learning, metrics, scoring, split
from riskloom.operators.inference import MODEL
from riskloom.operators.lifecycle import TIE, TIME
from riskloom.queries import operations, serving
from riskloom.queries.common import final, table
from riskloom.session import checkpoint, run_folder
from riskloom.streaming.lifecycle import read_registry, registry_sink, start_registry
from riskloom.streaming.metrics import alarm_sink, read_alarms, start_alarms, windowed
from riskloom.sources.requests import parse_requests, usable
from riskloom.streaming.scoring import model_score_requests, score_requests, start_scoring

# --- Imputation -----------------------------------------------------------------


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer, with holes in numbers and words."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    key = F.col("o_orderkey")
    return orders.join(customers, "o_custkey").select(
        "o_orderkey",
        F.when(key % 9 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 5 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 6 != 0, F.col("c_mktsegment")).alias("segment"),
    )


GAPS = """g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN c_acctbal END AS balance,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 6 <> 0 THEN c_mktsegment END AS segment FROM orders JOIN customer ON o_custkey = c_custkey)"""


def imputed(spark, folder):
    data = gaps(spark, folder)
    stages = [*learning.fill_by_median(data, ["price", "balance"]), *learning.fill_by_mode(data, ["priority", "segment"])]
    for stage in stages:
        data = stage.transform(data)
    return final(data.select("o_orderkey", "price", "balance", "priority", "segment"))


IMPUTED_SQL = f"""WITH {GAPS}
SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM g)), 6) AS price, round(coalesce(balance, (SELECT median(balance) FROM g)), 6) AS balance,
  coalesce(priority, (SELECT priority FROM g WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority,
  coalesce(segment, (SELECT segment FROM g WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment FROM g"""


def chained_imputation(spark, folder):
    """Every cell after two rounds."""
    data = gaps(spark, folder)
    for stage in learning.fill_by_regression(data, ["price", "balance"], rounds=2):
        data = stage.transform(data)
    return final(data.select("o_orderkey", "price", "balance"), 3)


def regressions_sql(rounds: int) -> str:
    """Tables s0 (means for gaps), s1 ... with price renewed from balance, then balance from price."""
    steps = ["s0 AS (SELECT g.*, coalesce(price, mp) AS p, coalesce(balance, mb) AS b FROM g, m)"]
    for r in range(1, rounds + 1):
        steps.append(
            f"""a{r} AS (SELECT regr_slope(price, b) AS w, regr_intercept(price, b) AS c FROM s{r - 1} WHERE price IS NOT NULL),
t{r} AS (SELECT s.* REPLACE (coalesce(price, c + w * b) AS p) FROM s{r - 1} s, a{r}),
d{r} AS (SELECT regr_slope(balance, p) AS w, regr_intercept(balance, p) AS c FROM t{r} WHERE balance IS NOT NULL),
s{r} AS (SELECT t.* REPLACE (coalesce(balance, c + w * p) AS b) FROM t{r} t, d{r})"""
        )
    return ", ".join(steps)


CHAINED_SQL = f"""WITH {GAPS}, m AS (SELECT avg(price) AS mp, avg(balance) AS mb FROM g), {regressions_sql(2)}
SELECT o_orderkey, round(p, 3) AS price, round(b, 3) AS balance FROM s2"""

def one_hot(spark, folder):
    """Slots of two text columns, of which one has gaps and the words of it are learned from a part of the rows."""
    data = gaps(spark, folder).select("o_orderkey", "priority", "segment")
    known = data.where(F.col("o_orderkey") % 2 == 0).where("segment <> 'BUILDING' OR segment IS NULL")
    stages = [*learning.fill_by_mode(known, ["priority", "segment"]), *learning.encode_stages(["priority", "segment"])]
    model = Pipeline(stages=stages).fit(known)
    slots = [F.array_join(vector_to_array(f"{c}{learning.ENCODED}").cast("array<int>"), "").alias(f"{c}_slots") for c in ("priority", "segment")]
    return final(model.transform(data).select("o_orderkey", *slots))


def slots_sql(column: str) -> str:
    """A 1 in the place of the word among the sorted words of the known rows; none for a word that is not there."""
    words = f"(SELECT list(DISTINCT coalesce({column}, mode_{column}) ORDER BY coalesce({column}, mode_{column})) FROM known, modes)"
    return f"array_to_string(list_transform({words}, lambda w: CASE WHEN w = coalesce({column}, mode_{column}) THEN 1 ELSE 0 END), '') AS {column}_slots"


ONE_HOT_SQL = f"""WITH {GAPS}, known AS (SELECT * FROM g WHERE o_orderkey % 2 = 0 AND (segment <> 'BUILDING' OR segment IS NULL)),
modes AS (SELECT {", ".join(f"(SELECT {c} FROM known WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_{c}" for c in ("priority", "segment"))})
SELECT o_orderkey, {slots_sql("priority")}, {slots_sql("segment")} FROM g, modes"""

# --- Models ---------------------------------------------------------------------

NUMERIC, TEXT = ["n_chars", "n_words", "n_lines"], ["lang", "source"]


def model_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    features = docs.select(
        "doc_id",
        F.col("n_chars").cast("double"),
        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        F.when(F.col("doc_id") % 4 != 0, F.size(F.split("text", "\n"))).cast("double").alias("n_lines"),
        "lang",
        "source",
    )
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("target_true"))
    return split.stratified_split(features.join(labels, "doc_id"), "doc_id", "target_true")


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    data = checkpoint(model_table(spark, folder))
    return data.filter("split = 'train'").drop("split"), data.filter("split = 'test'").drop("split")


def baselines(spark, folder):
    """CV summary of the three baselines."""
    train, test = _parts(spark, folder)
    train = split.stratified_folds(train, "doc_id", "target_true", FOLDS)
    cv, _, _ = learning.run_baselines(train, test, learning.baseline_specs(), NUMERIC, TEXT, "doc_id", FOLDS)
    return final(cv)


def best_baseline(spark, folder):
    train, test = _parts(spark, folder)
    train = split.stratified_folds(train, "doc_id", "target_true", FOLDS)
    specs, path = learning.baseline_specs(), run_folder(spark, "best")
    cv, held_out, models = learning.run_baselines(train, test, specs, NUMERIC, TEXT, "doc_id", FOLDS)
    best = checkpoint(learning.select_best(cv, metrics.metric_table(held_out, [MODEL])))
    learning.save(models[best.first()[MODEL]], f"{path}/model")
    held_out.write.parquet(f"{path}/predictions")
    record = learning.best_record(best, specs, {"model_path": f"{path}/model", "predictions_path": f"{path}/predictions"})
    stored = spark.read.parquet(f"{path}/predictions").groupBy(MODEL).agg(F.count(F.lit(1)).alias("stored_predictions"))
    return final(record.drop("model_path", "predictions_path").join(stored, MODEL))


def searched(spark, folder):
    """Search over classifiers and imputers, the best three as a weighted ensemble, bands of the held-out part.

    No time budget: all folds are tried on tables of any size, and their scores decide on the weights.
    """
    train, test = _parts(spark, folder)
    train = split.stratified_folds(train, "doc_id", "target_true", FOLDS)
    space = learning.SearchSpace(
        classifiers={
            "forest": learning.Drawn(learning.random_forest, {"trees": [100, 300], "depth": [4, 5, 6]}),
            "boosting": learning.Drawn(learning.gradient_boosting, {"rounds": [100, 300], "step": [0.05, 0.1], "depth": [3, 4]}),
            "logistic": learning.logistic_regression,
        },
        imputers=("ice",),
        time_budget=float("inf"),
        ensemble_size=3,
    )
    result = learning.search(train, space, NUMERIC, TEXT, "doc_id", FOLDS)
    scored = learning.predict_ensemble(result.members, test, "doc_id", "ensemble")
    score = scoring.probability(F.col("risk_score"))
    return final(scored.select("row_index", MODEL, "target_true", "prediction_label", score.alias("risk_score"), scoring.band(score).alias("band")))


def boosted(spark, folder):
    """Boosting on one feature of few values: every value is a leaf of its own, whose score SQL can follow round by round."""
    rows = table(spark, folder, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), (F.col("o_orderstatus") == "F").cast("int").alias("target_true")
    )
    vectors = VectorAssembler(inputCols=["priority"], outputCol=learning.VECTOR).transform(rows)
    setting = boosting.BoostSetting(rounds=300, step=0.05, depth=4, least=0.0)
    model = boosting.HistogramBoosting(setting, featuresCol=learning.VECTOR, labelCol="target_true").fit(vectors)
    cells = vectors.groupBy("priority").agg(F.count(F.lit(1)).alias("row_count"), F.sum("target_true").alias("positives"), F.first(learning.VECTOR).alias(learning.VECTOR))
    return final(model.transform(cells).select("priority", "row_count", "positives", learning.positive_probability().alias("probability")))


BOOSTED_SQL = """
WITH RECURSIVE c AS MATERIALIZED (SELECT substr(o_orderpriority, 1, 1)::DOUBLE AS priority, count(*)::DOUBLE AS n, sum((o_orderstatus = 'F')::INT)::DOUBLE AS k FROM orders GROUP BY 1),
r(step, priority, n, k, f) AS (SELECT 0, priority, n, k, 0.0::DOUBLE FROM c
  UNION ALL SELECT step + 1, priority, n, k, f + 0.05::DOUBLE * (k - n / (1 + exp(-f))) / (n / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f))) + 1) FROM r WHERE step < 300)
SELECT priority, n::BIGINT AS row_count, k::BIGINT AS positives, round(1 / (1 + exp(-f)), 6) AS probability FROM r WHERE step = 300"""


def restored(spark, folder):
    """A saved and restored model scores like the fitted one: rows with any difference."""
    train, test = _parts(spark, folder)
    model = learning.fit(train, learning.ModelSpec("logistic_regression", learning.logistic_regression), NUMERIC, TEXT)
    path = run_folder(spark, "model")
    learning.save(model, path)
    fitted = learning.predict(model, test, "doc_id", "m").select("row_index", "risk_score")
    loaded = learning.predict(learning.load(path), test, "doc_id", "m").select("row_index", F.col("risk_score").alias("restored_score"))
    both = fitted.join(loaded, "row_index")
    return final(
        both.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.abs(F.col("risk_score") - F.col("restored_score")) > 1e-12).alias("differences"))
    )


RESTORED_SQL = "SELECT (SELECT ceil(0.2::DOUBLE * count(*)) FROM labels)::BIGINT AS row_count, 0::BIGINT AS differences"

# --- Serving a fitted model ------------------------------------------------------


def counting_model():
    """Multinomial naive Bayes: its probabilities follow from sums of the features by class, which SQL can state."""
    return NaiveBayes(smoothing=1.0, modelType="multinomial", featuresCol=learning.VECTOR, labelCol="target_true")


def ensemble(spark, folder):
    """Weighted mean of three counting models of different features, in one scan."""
    data = serving.inputs(spark, folder)
    target = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 4000).cast("int").alias("target_true"))
    rows = data.join(target, "k").select("k", "target_true", *scoring.feature_columns(scoring.fields(data), ["su", "al", "dm", "htn", "cvd"], ["su", "al"]))
    spec = learning.ModelSpec("counts", counting_model)
    members = [(w, learning.fit(rows, spec, numbers, [word])) for w, numbers, word in MEMBERS]
    return final(learning.predict_ensemble(members, rows, "k", "three").select("row_index", "target_true", "prediction_label", "risk_score"))


MEMBERS = ((0.5, ["su", "al"], "dm"), (0.3, ["al", "su"], "htn"), (0.2, ["su", "al"], "cvd"))


def ensemble_sql() -> str:
    filled = ", ".join(f"coalesce({w}, (SELECT {w} FROM i WHERE {w} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {w}" for _, _, w in MEMBERS)
    parts = []
    for _, numbers, word in MEMBERS:
        ctes = counting_sql("t", numbers, word)
        parts.append(f"SELECT k, '{word}' AS member, p FROM (WITH {ctes} SELECT x.k, {joint_sql(numbers, word)} AS p FROM {joint_from('t', word)})")
    weights = " ".join(f"WHEN '{word}' THEN {w}" for w, _, word in MEMBERS)
    return f"""WITH {serving.INPUT_SQL},
t AS MATERIALIZED (SELECT k, (c_acctbal > 4000)::INT AS truth, su::DOUBLE AS su, al::DOUBLE AS al, {filled} FROM i JOIN customer ON k = c_custkey),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT k, sum(p * CASE member {weights} END) AS p FROM m GROUP BY 1)
SELECT k AS row_index, truth AS target_true, (p >= 0.5)::BIGINT AS prediction_label, round(p, 6) AS risk_score FROM s JOIN t USING (k)"""


def counting_sql(train: str, numbers: list[str], word: str) -> str:
    """Table `sums` of class, rows, smoothed shares of numbers and, in `words`, of words; from `train` (truth, numbers, word)."""
    total = " + ".join(f"sum({n})" for n in numbers)
    return f"""size AS (SELECT {len(numbers)} + count(DISTINCT {word}) AS d, count(*) AS n FROM {train}),
sums AS (SELECT truth, ln((count(*) + 1.0::DOUBLE) / (any_value(n) + 2)) AS prior, {", ".join(f"ln((sum({n}) + 1.0::DOUBLE) / ({total} + count(*) + any_value(d))) AS t_{n}" for n in numbers)},
  {total} + count(*) + any_value(d) AS bottom FROM {train}, size GROUP BY 1),
kinds AS (SELECT DISTINCT {word} FROM {train}),
words AS (SELECT sums.truth, kinds.{word}, ln((count(t.truth) + 1.0::DOUBLE) / any_value(bottom)) AS t_word FROM sums CROSS JOIN kinds LEFT JOIN {train} t ON t.truth = sums.truth AND t.{word} = kinds.{word} GROUP BY 1, 2)"""


def joint_sql(numbers: list[str], word: str) -> str:
    """Probability of class 1 for the rows of the FROM clause that follows, joined as given below."""
    one = " + ".join(f"x.{n} * (s1.t_{n} - s0.t_{n})" for n in numbers)
    return f"1 / (1 + exp(-(s1.prior - s0.prior + {one} + coalesce(w1.t_word - w0.t_word, 0))))"


def joint_from(rows: str, word: str) -> str:
    return f"""{rows} x JOIN sums s1 ON s1.truth = 1 JOIN sums s0 ON s0.truth = 0
  LEFT JOIN words w1 ON w1.truth = 1 AND w1.{word} = x.{word} LEFT JOIN words w0 ON w0.truth = 0 AND w0.{word} = x.{word}"""


def stored_bundle(spark: SparkSession, train: DataFrame, numeric: list[str], text: list[str], version: str) -> learning.Bundle:
    """Fitted, saved and read back, as a server would."""
    path = run_folder(spark, "bundle")
    learning.save_bundle(learning.fit_bundle(train, learning.ModelSpec("counts", counting_model), numeric, text, version), path)
    return learning.load_bundle(spark, path)


def model_scored(spark, folder):
    """Customers' inputs on both routes, scored by a model of dm and su; sod is a feature that no input has."""
    data = serving.inputs(spark, folder)
    target = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 4000).cast("int").alias("target_true"))
    numeric, words = ["su", "sod"], ["dm"]
    train = data.join(target, "k").select("target_true", *scoring.feature_columns(scoring.fields(data), ["sod", "dm", "su"], numeric))
    bundle = stored_bundle(spark, train, numeric, words, "counts-1")
    both = scoring.model_responses(data, bundle, "research", ["k"]).unionByName(scoring.model_responses(data, bundle, "clinical", ["k"]))
    return final(both.select("k", "risk_score", "prediction_label", "model_version", "serving_route", "notes", F.size("explanation").alias("items"), F.col("explanation")[0]["feature"].alias("first_feature")))


BANDS = "CASE WHEN risk_score >= 0.7 THEN 'high_risk' WHEN risk_score >= 0.4 THEN 'moderate_risk' ELSE 'lower_risk' END"
MODEL_SCORED_SQL = f"""
WITH {serving.INPUT_SQL}, mode AS (SELECT dm AS word FROM i WHERE dm IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
middle AS (SELECT median(su::DOUBLE) AS su FROM i),
t AS (SELECT (c_acctbal > 4000)::INT AS truth, coalesce(dm, word) AS dm, i.su::DOUBLE AS su, 0.0::DOUBLE AS sod FROM i JOIN customer ON k = c_custkey, mode),
{counting_sql("t", ["su", "sod"], "dm")},
said AS (SELECT k, 'research' AS route, coalesce(dm, word) AS dm, i.su::DOUBLE AS su, 0.0::DOUBLE AS sod FROM i, mode
 UNION ALL SELECT k, 'clinical', coalesce({serving._word('dm')}, word), middle.su, 0.0::DOUBLE FROM i, mode, middle),
scored AS (SELECT k, route, {joint_sql(["su", "sod"], "dm")} AS risk_score FROM {joint_from("said", "dm")}),
a AS (WITH {serving.contribution_sql(fixed.RESEARCH_TERMS, fixed.RESEARCH_FLAGS, fixed.RESEARCH_FALLBACK)} SELECT k, count(*) FILTER (place <= 6) AS items, max(feature) FILTER (place = 1) AS first_feature FROM ranked GROUP BY 1),
b AS (WITH {serving.contribution_sql(fixed.CLINICAL_TERMS, fixed.CLINICAL_FLAGS, fixed.CLINICAL_FALLBACK)} SELECT k, count(*) FILTER (place <= 6) AS items, max(feature) FILTER (place = 1) AS first_feature FROM ranked GROUP BY 1),
n AS (SELECT k, concat_ws(' ', {serving.text(fixed.CLINICAL_NOTE)}, {", ".join(f"CASE WHEN {c} IS NOT NULL THEN {serving.text(t)} END" for c, t in fixed.TRANSLATION_NOTES.items())}) AS notes FROM i)
SELECT k, round(risk_score, 6) AS risk_score, {BANDS} AS prediction_label, 'counts-1::' || route AS model_version, '/predict/' || route AS serving_route,
  CASE route WHEN 'clinical' THEN n.notes ELSE {serving.text(fixed.RESEARCH_NOTE)} END AS notes, e.items, e.first_feature
FROM scored JOIN n USING (k) JOIN (SELECT 'research' AS route, * FROM a UNION ALL SELECT 'clinical', * FROM b) e USING (k, route)"""


def stream_model_scored(spark, folder):
    """Requests of both routes as a stream, scored by a model fitted on the requests that are there; hemo is always missing."""
    parsed = usable(parse_requests(table(spark, folder, "events").withColumn("body", F.expr(serving.BODY)), "body"))
    field = scoring.either(F.col("mode") == "clinical", scoring.map_fields("inputs"))
    numeric, words = ["sc", "hemo"], ["dm"]
    train = parsed.select((F.col("value") > 50).cast("int").alias("target_true"), *scoring.feature_columns(field, ["sc", "dm", "hemo"], numeric))
    bundle = stored_bundle(spark, train, numeric, words, "counts-2")
    stream = event_stream(spark, folder).withColumn("body", F.expr(serving.BODY))
    path = run_folder(spark, "scored")
    start_scoring(model_score_requests(stream, "body", ["event_id"], bundle), f"{path}/rows", f"{path}/state").awaitTermination()
    return final(spark.read.parquet(f"{path}/rows").select("event_id", "risk_score", "prediction_label", "model_version", "serving_route"))


STREAM_MODEL_SQL = f"""
WITH {serving.PARSED}, f AS (SELECT event_id, m, (value > 50)::INT AS truth, CASE m WHEN 'clinical' THEN event_id % 6 + 0.5 ELSE event_id % 5 + 0.4 END::DOUBLE AS sc, 0.0::DOUBLE AS hemo, user_id % 2 AS dm FROM r WHERE rejection IS NULL),
{counting_sql("f", ["sc", "hemo"], "dm")},
scored AS (SELECT event_id, m, {joint_sql(["sc", "hemo"], "dm")} AS risk_score FROM {joint_from("f", "dm")})
SELECT event_id, round(risk_score, 6) AS risk_score, {BANDS} AS prediction_label, 'counts-2::' || m AS model_version, '/predict/' || m AS serving_route FROM scored"""

# --- Streams --------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events file as a file stream."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")


def stream_scoring(spark, folder):
    stream = event_stream(spark, folder).withColumn("body", F.expr(serving.BODY))
    path = run_folder(spark, "scored")
    start_scoring(score_requests(stream, "body", ["event_id"]), f"{path}/rows", f"{path}/state").awaitTermination()
    scored = spark.read.parquet(f"{path}/rows")
    return final(scored.select("event_id", "risk_score", "prediction_label", "model_version", "serving_route"))


STREAM_SCORING_SQL = f"SELECT event_id, risk_score, prediction_label, model_version, serving_route FROM ({serving.SCORED_SQL})"


def stream_windows(spark, folder):
    error = F.col("event_type") == "error"
    metrics_ = windowed(event_stream(spark, folder), "ts", "value", error, 3600, server_error=error & (F.col("value") > 50))
    path = run_folder(spark, "windows")
    query = (
        metrics_.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return final(spark.read.parquet(f"{path}/rows").select("period", "requests", "errors", "server_errors", "max_ms", "p50_ms", "p95_ms"))


STREAM_WINDOWS_SQL = """
SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS period, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (event_type = 'error' AND value > 50) AS server_errors, round(max(value), 6) AS max_ms, round(quantile_disc(value, 0.5), 6) AS p50_ms, round(quantile_disc(value, 0.95), 6) AS p95_ms
FROM events GROUP BY 1 HAVING period + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)"""


def stream_alarm(spark, folder):
    """Error alarm over finished one-hour windows of the stream, decided on a dense calendar."""
    metrics_ = windowed(event_stream(spark, folder), "ts", "value", F.col("event_type") == "error", 3600)
    path = run_folder(spark, "alarms")
    alarm = operations.Alarm("many-errors", "errors", "sum", 3600, 3, 2, 4.0, ">=")
    sink = alarm_sink(f"{path}/metrics", f"{path}/states", "errors", alarm, [], 3600)
    start_alarms(metrics_, sink, f"{path}/state").awaitTermination()
    return final(read_alarms(spark, f"{path}/states"))


STREAM_ALARM_SQL = f"""
WITH m AS ({STREAM_WINDOWS_SQL}), c AS (SELECT unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), 3600)) AS period),
b AS (SELECT c.period, errors, coalesce(errors >= 4, false)::BIGINT AS breaching FROM c LEFT JOIN m USING (period)),
w AS (SELECT *, sum(breaching) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS breaches FROM b)
SELECT 'many-errors' AS alarm, period, errors, breaching, breaches, breaches >= 2 AS in_alarm FROM w"""


def stream_5xx_alarm(spark, folder):
    """Any server error in an hour raises the alarm."""
    error = (F.col("event_type") == "error") & (F.col("value") > 50)
    metrics_ = windowed(event_stream(spark, folder), "ts", "value", F.col("event_type") == "error", 3600, server_error=error)
    path = run_folder(spark, "alarms")
    alarm = operations.Alarm("any-5xx", "server_errors", "sum", 3600, 1, 1, 1.0, ">=")
    sink = alarm_sink(f"{path}/metrics", f"{path}/states", "server_errors", alarm, [], 3600)
    start_alarms(metrics_, sink, f"{path}/state").awaitTermination()
    return final(read_alarms(spark, f"{path}/states").select("alarm", "period", "server_errors", "in_alarm"))


STREAM_5XX_SQL = f"""
WITH m AS ({STREAM_WINDOWS_SQL}), c AS (SELECT unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), 3600)) AS period)
SELECT 'any-5xx' AS alarm, c.period, server_errors, coalesce(server_errors >= 1, false) AS in_alarm FROM c LEFT JOIN m USING (period)"""


def stream_registry(spark, folder):
    """Registry state kept by the stream."""
    stream = event_stream(spark, folder)
    log = operations.as_lifecycle(stream, 3)
    path = run_folder(spark, "registry")
    start_registry(log.select("registry", "model_id", "event_type", TIME, TIE), registry_sink(f"{path}/facts", ["registry"]), f"{path}/state").awaitTermination()
    return final(read_registry(spark, f"{path}/facts", ["registry"]).select(*operations.STATE_COLUMNS))


QUERIES = {
    "model_imputed": imputed,
    "model_one_hot": one_hot,
    "model_chained_imputation": chained_imputation,
    "model_baselines_cv": baselines,
    "model_best_baseline": best_baseline,
    "model_search_ensemble": searched,
    "model_boosting_cells": boosted,
    "model_weighted_ensemble": ensemble,
    "model_save_restore": restored,
    "model_scored_batch": model_scored,
    "stream_model_scored": stream_model_scored,
    "stream_scored_requests": stream_scoring,
    "stream_window_metrics": stream_windows,
    "stream_alarm_states": stream_alarm,
    "stream_5xx_alarm": stream_5xx_alarm,
    "stream_registry_state": stream_registry,
}
ORACLE = {
    "model_imputed": IMPUTED_SQL,
    "model_one_hot": ONE_HOT_SQL,
    "model_chained_imputation": CHAINED_SQL,
    "model_boosting_cells": BOOSTED_SQL,
    "model_weighted_ensemble": ensemble_sql(),
    "model_save_restore": RESTORED_SQL,
    "model_scored_batch": MODEL_SCORED_SQL,
    "stream_model_scored": STREAM_MODEL_SQL,
    "stream_scored_requests": STREAM_SCORING_SQL,
    "stream_window_metrics": STREAM_WINDOWS_SQL,
    "stream_alarm_states": STREAM_ALARM_SQL,
    "stream_5xx_alarm": STREAM_5XX_SQL,
    "stream_registry_state": operations.MODEL_STATE_SQL,
}
