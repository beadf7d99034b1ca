"""File sources and sinks: the given tables are written, appended to and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import audit
from riskloom.plans.runlog import SCHEMA as RUN_SCHEMA
from riskloom.plans.runlog import logged
from riskloom.queries import evaluation, harmonise, operations
from riskloom.queries.common import final, table
from riskloom.session import run_folder
from riskloom.sources import logs, tables


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes, commas, missing cells and missing marks survive or vanish as the reader says."""
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit('a "'), "c_name", F.lit('", b')).alias("c_name"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.array("c_nationkey", "c_custkey").alias("pair"),
    )
    path = run_folder(spark, "csv")
    tables.write_csv(customers, path)
    back = tables.read_csv(spark, path)
    return final(back.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"), "c_mktsegment", "pair"))


CSV_SQL = """
SELECT c_custkey, 'a "' || c_name || '", b' AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal, 6) END AS c_acctbal,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment, '[' || c_nationkey || ',' || c_custkey || ']' AS pair FROM customer"""


def tagged_files(spark: SparkSession, folder: str) -> DataFrame:
    """The predictions of each model as a file of its own, read as one table."""
    predictions, path = evaluation.predictions(spark, folder), run_folder(spark, "predictions")
    names = ("coin", "price", "blend")
    for name in names:
        own = predictions.where(F.col("model_name") == name)
        tables.write_csv(own.select("row_index", "target_true", "prediction_label", "risk_score"), f"{path}/{name}")
    return final(tables.read_tagged(spark, {n: f"{path}/{n}" for n in names}, tables.PREDICTION_SCHEMA))


TAGGED_SQL = f"WITH {evaluation.PREDICTIONS} SELECT row_index, target_true, prediction_label, round(risk_score, 6) AS risk_score, model_name FROM pred"


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each nation and market segment, with its customers inside."""
    customers = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    docs = customers.agg(F.round(F.sum("c_acctbal"), 2).alias("balance"), F.sort_array(F.collect_list("c_custkey")).alias("customers"))
    path = run_folder(spark, "documents")
    tables.write_json(docs, path, one_each=True)
    back = tables.read_document(spark, path, "nation long, segment string, balance double, customers array<long>")
    return final(back.select("nation", "segment", "balance", F.array_join(F.col("customers").cast("array<string>"), ",").alias("customers")), 2)


DOCUMENTS_SQL = """
SELECT c_nationkey AS nation, c_mktsegment AS segment, round(sum(c_acctbal), 2) AS balance, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS customers
FROM customer GROUP BY 1, 2"""


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A log that two runs append to."""
    log = operations.lifecycle_events(spark, folder).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_time").cast("string").alias("timestamp"),
        F.when(F.col("event_type") != "retired", F.col("event_type")).alias("event_type"), "model_id",
    )
    path = run_folder(spark, "log")
    for part in (0, 1):
        tables.append_events(log.where(F.col("event_id").cast("long") % 2 == part), path)
    return final(tables.read_events(spark, path).select("event_id", "timestamp", "event_type", "model_id", "reason"))


LINES_SQL = f"""WITH {operations.lifecycle_sql(1)}
SELECT event_id::VARCHAR AS event_id, event_time::VARCHAR AS timestamp, event_type, model_id, NULL::VARCHAR AS reason FROM e WHERE event_type <> 'retired'"""


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("GET /"), "event_type").alias("routeKey"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"), F.col("value").alias("responseLatency"),
        F.lit("x").alias("path"), F.lit("y").alias("sourceIp"),
    )
    path = run_folder(spark, "access")
    tables.write_json(rows, path)
    read = logs.read_access_log(spark, path)
    days = read.groupBy("routeKey", "status", F.unix_date(F.to_date("timestamp")).alias("day"))
    return final(days.agg(F.count(F.lit(1)).alias("requests"), F.max("responseLatency").alias("max_latency")))


ACCESS_SQL = """
SELECT 'GET /' || event_type AS routeKey, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
  (ts::DATE - DATE '1970-01-01')::BIGINT AS day, count(*) AS requests, round(max(value), 6) AS max_latency FROM events GROUP BY 1, 2, 3"""


def latency_samples(spark: SparkSession, folder: str) -> DataFrame:
    samples = table(spark, folder, "events").select(
        F.col("event_type").alias("route_name"), F.lit("measured").alias("phase"), F.col("event_id").alias("iteration"),
        F.lit("t").alias("timestamp_utc"), F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), (F.col("event_type") != "error").alias("ok"),
        F.lit(0.5).alias("risk_score"), F.lit("low").alias("prediction_label"), F.lit("v1").alias("model_version"),
        F.lit("r").alias("serving_route"), F.when(F.col("event_type") == "error", "failed, twice").alias("error"),
    )
    path = run_folder(spark, "samples")
    tables.write_samples(samples, path)
    return final(tables.read_csv(spark, path, tables.LATENCY_SCHEMA).select("route_name", "iteration", "elapsed_ms", "status_code", "ok", "error"))


SAMPLES_SQL = """
SELECT event_type AS route_name, event_id AS iteration, round(value, 6) AS elapsed_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'failed, twice' END AS error FROM events"""


def kept_template(spark: SparkSession, folder: str) -> DataFrame:
    """A template that a reviewer has answered is not written again."""
    a, b = harmonise.sources(spark, folder)
    found = audit.direction_audit(a, b, ["flag", "state"], "target", "p_partkey", harmonise.GROUPS)
    template = audit.confirmation_template(found.select("feature_name", "manual_review_required"))
    path = run_folder(spark, "template")
    tables.write_once(template.withColumn("safe_to_apply_binary_harmonization", F.lit("yes")), path)
    tables.write_once(template, path)
    return final(spark.read.parquet(path))


TEMPLATE_SQL = f"""WITH {harmonise.STRICT}
SELECT feature_name, 'yes' AS manual_review_required, '' AS confirmed_b_meaning_for_0, '' AS confirmed_b_meaning_for_1,
  '' AS confirmed_mapping_to_a, 'yes' AS safe_to_apply_binary_harmonization FROM strict WHERE feature_name IN ('flag', 'state')"""


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """The life of two jobs: one counts, one fails with what it has counted."""
    path = run_folder(spark, "runs")
    orders = table(spark, folder, "orders")

    def fail() -> None:
        raise ValueError(f"{orders.where(F.col('o_orderstatus') == 'F').count()} finished orders")

    logged(spark, path, "count", orders.count)
    try:
        logged(spark, path, "check", fail)
    except ValueError:
        pass
    return final(spark.read.schema(RUN_SCHEMA).json(path).select("run_name", "status", "error_type", "error_message"))


RUN_SQL = """
SELECT run_name, status, CASE WHEN status = 'failed' THEN 'ValueError' END AS error_type,
  CASE WHEN status = 'failed' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') || ' finished orders' END AS error_message
FROM (VALUES ('count', 'started'), ('count', 'success'), ('check', 'started'), ('check', 'failed')) r(run_name, status)"""


QUERIES = {
    "file_csv": csv_round_trip,
    "file_tagged": tagged_files,
    "file_documents": json_documents,
    "file_json_lines": json_lines,
    "file_access_log": access_log,
    "file_latency_samples": latency_samples,
    "file_template_kept": kept_template,
    "file_run_log": run_log,
}
ORACLE = {
    "file_csv": CSV_SQL,
    "file_tagged": TAGGED_SQL,
    "file_documents": DOCUMENTS_SQL,
    "file_json_lines": LINES_SQL,
    "file_access_log": ACCESS_SQL,
    "file_latency_samples": SAMPLES_SQL,
    "file_template_kept": TEMPLATE_SQL,
    "file_run_log": RUN_SQL,
}
