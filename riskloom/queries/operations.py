"""Latency, access logs, windowed alarms, log lines and the model life cycle, all read from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.fixed import Alarm
from riskloom.operators import contracts, lifecycle, monitor
from riskloom.queries.common import final, table
from riskloom.sources.logs import cold_starts, parse_reports


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


# --- Latency and access ---------------------------------------------------------


def latency_summary(spark, folder):
    """Route = user group, success = not an error, warm-up = every tenth event."""
    samples = events(spark, folder).select(
        F.concat(F.lit("route"), (F.col("user_id") % 4).cast("string")).alias("route_name"),
        F.when(F.col("event_id") % 10 == 0, F.lit("warmup")).otherwise("measured").alias("phase"),
        F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        (F.col("event_type") != "signup").alias("ok"),
    )
    return final(monitor.latency_summary(monitor.measured(samples)))


LATENCY_SQL = """
WITH s AS (SELECT 'route' || (user_id % 4) AS route, value AS ms, event_type NOT IN ('error', 'signup') AS good FROM events WHERE event_id % 10 <> 0)
SELECT route, count(*) AS n_total, count(*) FILTER (good) AS n_success, count(*) FILTER (NOT good) AS n_failure,
  round(avg(ms) FILTER (good), 2) AS mean_ms, round(median(ms) FILTER (good), 2) AS median_ms, round(quantile_cont(ms, 0.5) FILTER (good), 2) AS p50_ms,
  round(quantile_cont(ms, 0.95) FILTER (good), 2) AS p95_ms, round(quantile_cont(ms, 0.99) FILTER (good), 2) AS p99_ms,
  round(min(ms) FILTER (good), 2) AS min_ms, round(max(ms) FILTER (good), 2) AS max_ms FROM s GROUP BY 1"""


def null_route(spark, folder):
    """Samples without a route are a route of their own."""
    samples = events(spark, folder).select(
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("route"), (F.col("user_id") % 4).cast("string"))).alias("route_name"),
        F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        (F.col("event_type") != "signup").alias("ok"),
    )
    return final(monitor.latency_summary(samples))


NULL_ROUTE_SQL = LATENCY_SQL.replace("'route' || (user_id % 4)", "CASE WHEN user_id % 4 <> 0 THEN 'route' || (user_id % 4) END").replace(
    " WHERE event_id % 10 <> 0", ""
)


def access_statistics(spark, folder):
    log = events(spark, folder).select("event_type", (F.col("user_id") % 3).alias("status"), "value")
    return final(monitor.access_statistics(log, "event_type", "status", "value"))


ACCESS_SQL = """
SELECT event_type AS route, user_id % 3 AS status, count(*) AS requests, round(avg(value), 6) AS avg_latency_ms, round(max(value), 6) AS max_latency_ms
FROM events GROUP BY 1, 2"""


def latest_events(spark, folder):
    newest = monitor.latest(events(spark, folder).select("event_id", "ts", "event_type", "value"), [F.desc("ts"), F.desc("event_id")], 50)
    return final(newest.drop("ts"))


LATEST_SQL = "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"


def latest_per_type(spark, folder):
    rows = events(spark, folder).select("event_type", "event_id", "ts")
    return final(monitor.latest_per_key(rows, ["event_type"], [F.desc("ts"), F.desc("event_id")], 5).drop("ts"))


LATEST_TYPE_SQL = """
SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5"""

# --- Windows and alarms ---------------------------------------------------------

HOUR = 3600


def window_metrics(spark, folder):
    log = events(spark, folder)
    return final(
        monitor.window_metrics(
            log, "ts", "value", F.col("event_type") == "error", HOUR, server_error=F.col("event_type") == "signup"
        )
    )


WINDOW_SQL = """
SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS period, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS server_errors,
  round(max(value), 6) AS max_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms
FROM events GROUP BY 1"""

P95_ALARM = Alarm("p95-high", "duration_ms", "p95", HOUR, 3, 2, 150.0, ">")
ERROR_ALARM = Alarm("errors-any", "errors", "sum", 60, 1, 1, 1.0, ">=")


def p95_alarm(spark, folder):
    metrics = monitor.window_metrics(events(spark, folder), "ts", "value", F.col("event_type") == "error", HOUR)
    return final(monitor.alarm_states(metrics, "p95_ms", P95_ALARM))


P95_SQL = """
WITH m AS (SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS period, quantile_cont(value, 0.95) AS p95_ms FROM events GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), 3600)) AS period),
b AS (SELECT c.period, p95_ms, coalesce(p95_ms > 150, false)::BIGINT AS breaching FROM c LEFT JOIN m USING (period)),
w AS (SELECT *, sum(breaching) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS breaches FROM b)
SELECT 'p95-high' AS alarm, period, round(p95_ms, 6) AS p95_ms, breaching, breaches, breaches >= 2 AS in_alarm FROM w"""


def error_alarm(spark, folder):
    """One-minute error alarm per event source, on a dense calendar."""
    log = events(spark, folder).withColumn("site", F.col("user_id") % 2)
    metrics = monitor.window_metrics(log, "ts", "value", F.col("event_type") == "error", 60, ["site"])
    states = monitor.alarm_states(metrics, "errors", ERROR_ALARM, ["site"])
    return final(
        states.groupBy("site", "alarm", "in_alarm").agg(
            F.count(F.lit(1)).alias("periods"), F.sum("errors").alias("errors"), F.min("period").alias("first_period")
        )
    )


ERROR_SQL = """
WITH m AS (SELECT user_id % 2 AS site, (epoch(date_trunc('minute', ts)))::BIGINT AS period, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2),
s AS (SELECT site, min(period) AS a, max(period) AS b FROM m GROUP BY 1),
c AS (SELECT site, unnest(generate_series(a, b, 60)) AS period FROM s),
x AS (SELECT site, period, errors, coalesce(errors >= 1, false) AS in_alarm FROM c LEFT JOIN m USING (site, period))
SELECT site, 'errors-any' AS alarm, in_alarm, count(*) AS periods, sum(errors)::BIGINT AS errors, min(period) AS first_period FROM x GROUP BY 1, 3"""

# --- Report lines ---------------------------------------------------------------

LINE = """CASE event_type WHEN 'view' THEN concat('START RequestId: ', event_id) ELSE
 concat('REPORT RequestId: r', event_id, CHR(9), 'Duration: ', user_id, '.5 ms', CHR(9), 'Billed Duration: ', user_id + 1, ' ms', CHR(9), 'Memory Size: 3008 MB', CHR(9), 'Max Memory Used: ', 100 + event_id % 50, ' MB', CHR(9),
 CASE WHEN event_type = 'signup' THEN concat('Init Duration: ', event_id % 900, '.25 ms', CHR(9)) ELSE '' END) END"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("logged"), F.expr(LINE).alias("message")
    )


def report_lines(spark, folder):
    parsed = parse_reports(lines(spark, folder), "message", ("event_id",))
    return final(parsed)


REPORT_SQL = """
SELECT event_id, 'r' || event_id AS request_id, user_id + 0.5::DOUBLE AS duration_ms, (user_id + 1)::DOUBLE AS billed_duration_ms, 3008.0::DOUBLE AS memory_size_mb,
  (100 + event_id % 50)::DOUBLE AS max_memory_used_mb, CASE WHEN event_type = 'signup' THEN event_id % 900 + 0.25::DOUBLE END AS init_duration_ms
FROM events WHERE event_type <> 'view'"""


def cold(spark, folder):
    return final(cold_starts(lines(spark, folder), "message", "logged").drop("logged"))


COLD_SQL = """
SELECT 'r' || event_id AS request_id, user_id + 0.5::DOUBLE AS duration_ms, (user_id + 1)::DOUBLE AS billed_duration_ms, 3008.0::DOUBLE AS memory_size_mb,
  (100 + event_id % 50)::DOUBLE AS max_memory_used_mb, event_id % 900 + 0.25::DOUBLE AS init_duration_ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc
FROM events WHERE event_type = 'signup' ORDER BY epoch_ms(ts) DESC, 1 LIMIT 5"""

# --- Model life cycle -----------------------------------------------------------


def lifecycle_events(spark: SparkSession, folder: str, registries: int = 1) -> DataFrame:
    return as_lifecycle(events(spark, folder), registries)


def as_lifecycle(log: DataFrame, registries: int) -> DataFrame:
    """Events as a life-cycle log: signup registers, view approves, purchase promotes, error rolls back, a click approves or, when slow, retires."""
    kind = (
        F.when(F.col("event_type") == "signup", "registered")
        .when(F.col("event_type") == "view", "approved")
        .when(F.col("event_type") == "purchase", "promoted")
        .when(F.col("event_type") == "error", "rolled_back")
        .when(F.col("value") > 200, "retired")
        .otherwise("approved")
    )
    return log.select(
        (F.col("user_id") % registries).alias("registry"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model_id"),
        kind.alias("event_type"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000).cast("long").alias("event_time"),
        "event_id",
    )


def lifecycle_sql(registries: int) -> str:
    return f"""
e AS (SELECT user_id % {registries} AS registry, 'm' || user_id AS model_id, CASE event_type WHEN 'signup' THEN 'registered' WHEN 'view' THEN 'approved' WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'rolled_back' ELSE CASE WHEN value > 200 THEN 'retired' ELSE 'approved' END END AS event_type,
        epoch_us(ts) // 60000000 AS event_time, event_id FROM events),
act AS (SELECT registry, arg_max(model_id, (event_time, event_id)) AS active_model_id FROM e WHERE event_type IN ('promoted', 'rolled_back') GROUP BY 1),
last AS (SELECT registry, model_id, arg_max(event_type, (event_time, event_id)) AS last_event, max(event_time) AS last_time, count(*) AS event_count FROM e GROUP BY 1, 2),
state AS (SELECT last.*, active_model_id, CASE WHEN last_event = 'registered' THEN 'candidate' WHEN last_event = 'approved' THEN 'approved' WHEN last_event = 'retired' THEN 'retired'
            WHEN model_id = active_model_id THEN 'active' ELSE 'approved' END AS status FROM last LEFT JOIN act USING (registry)),
hist AS (SELECT *, last_value(CASE WHEN event_type IN ('promoted', 'rolled_back') THEN model_id END IGNORE NULLS) OVER (PARTITION BY registry ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_active,
            lag(event_type) OVER (PARTITION BY registry, model_id ORDER BY event_time, event_id) AS previous_event FROM e),
prev AS (SELECT *, CASE WHEN previous_event = 'registered' THEN 'candidate' WHEN previous_event = 'approved' THEN 'approved' WHEN previous_event = 'retired' THEN 'retired'
            WHEN previous_event IS NOT NULL AND model_id = previous_active THEN 'active' WHEN previous_event IS NOT NULL THEN 'approved' END AS previous_status FROM hist)"""


STATE_COLUMNS = ("registry", "model_id", "last_event", "last_time", "event_count", "active_model_id", "status")


def model_state(spark, folder):
    return final(lifecycle.model_state(lifecycle_events(spark, folder, 3), ["registry"]).select(*STATE_COLUMNS))


def null_registry(spark, folder):
    """Models of no registry have their own state."""
    log = lifecycle_events(spark, folder, 3).withColumn("registry", F.when(F.col("registry") != 0, F.col("registry")))
    return final(lifecycle.model_state(log, ["registry"]).select(*STATE_COLUMNS))


NULL_REGISTRY_SQL = f"WITH {lifecycle_sql(3)} SELECT nullif(registry, 0) AS registry, {', '.join(STATE_COLUMNS[1:])} FROM state"

MODEL_STATE_SQL = f"WITH {lifecycle_sql(3)} SELECT {', '.join(STATE_COLUMNS)} FROM state"


def transition_audit(spark, folder):
    """One registry holds the whole log."""
    found = lifecycle.transition_audit(lifecycle_events(spark, folder).drop("registry"))
    return final(found.select("event_id", "model_id", "event_type", "previous_status", "previous_active", "violation"))


AUDIT_SQL = f"""WITH {lifecycle_sql(1)},
v AS (SELECT *, CASE WHEN event_type = 'approved' AND previous_status = 'retired' THEN 'retired_cannot_be_approved' WHEN event_type = 'approved' AND previous_status = 'active' THEN 'active_is_already_approved'
  WHEN event_type = 'promoted' AND coalesce(previous_status NOT IN ('approved', 'active'), true) THEN 'only_approved_can_be_promoted' WHEN event_type = 'promoted' AND model_id = previous_active THEN 'already_active'
  WHEN event_type = 'rolled_back' AND previous_active IS NULL THEN 'no_active_model_to_roll_back_from' WHEN event_type = 'rolled_back' AND coalesce(previous_status NOT IN ('approved', 'active'), true) THEN 'rollback_target_not_approved'
  WHEN event_type = 'rolled_back' AND model_id = previous_active THEN 'rollback_target_is_current' END AS violation FROM prev)
SELECT event_id, model_id, event_type, previous_status, previous_active, violation FROM v WHERE violation IS NOT NULL"""


def rollback(spark, folder):
    return final(lifecycle.rollback_targets(lifecycle_events(spark, folder, 3), ["registry"]))


ROLLBACK_SQL = f"""WITH {lifecycle_sql(3)},
s AS (SELECT h.registry, h.previous_active, h.event_time, h.event_id, st.active_model_id FROM hist h JOIN state st ON st.registry = h.registry AND st.model_id = h.previous_active
      WHERE h.event_type IN ('promoted', 'rolled_back') AND st.status IN ('approved', 'active') AND st.model_id IS DISTINCT FROM st.active_model_id)
SELECT registry, arg_max(previous_active, (event_time, event_id)) AS rollback_model_id, max(active_model_id) AS active_model_id FROM s GROUP BY 1"""


def resolve(spark, folder):
    state = lifecycle.model_state(lifecycle_events(spark, folder, 7), ["registry"])
    named = lifecycle.active_models(lifecycle_events(spark, folder, 7), ["registry"]).filter("registry % 2 = 0")
    return final(lifecycle.resolve_active(state.select("registry", "model_id", "status"), named, ["registry"]))


RESOLVE_SQL = f"""WITH {lifecycle_sql(7)}, f AS (SELECT registry, count(*) AS n, count(*) FILTER (status = 'active') AS a, max(model_id) FILTER (status = 'active') AS aid, max(model_id) AS any_id FROM state GROUP BY 1)
SELECT registry, CASE WHEN registry % 2 = 0 AND act.active_model_id IS NOT NULL THEN 'named' WHEN a = 1 THEN 'only_active' WHEN n = 1 THEN 'only_model' END AS resolution,
  CASE WHEN registry % 2 = 0 AND act.active_model_id IS NOT NULL THEN act.active_model_id WHEN a = 1 THEN aid WHEN n = 1 THEN any_id END AS active_model_id FROM f LEFT JOIN act USING (registry)"""


def upsert(spark, folder):
    """Registry rows of the log; every registry then activates one entry."""
    state = lifecycle.model_state(lifecycle_events(spark, folder, 3), ["registry"]).select("registry", "model_id", "status")
    entries = state.groupBy("registry").agg(F.min("model_id").alias("model_id"), F.lit("candidate").alias("status")).filter("registry > 0")
    return final(lifecycle.upsert(state, entries, ["registry", "model_id"], True, ["registry"]))


UPSERT_SQL = f"""WITH {lifecycle_sql(3)}, n AS (SELECT registry, min(model_id) AS model_id FROM state WHERE registry > 0 GROUP BY 1)
SELECT registry, model_id, CASE WHEN status = 'active' AND registry > 0 THEN 'approved' ELSE status END AS status FROM state WHERE (registry, model_id) NOT IN (SELECT (registry, model_id) FROM n)
UNION ALL SELECT registry, model_id, 'active' FROM n"""


def registry_checks(spark, folder):
    """Registry rows with a broken status or no id, and active ids nobody knows."""
    key = F.col("c_custkey")
    models = table(spark, folder, "customer").select(
        F.when(key % 101 != 0, F.concat(F.lit("m"), key.cast("string"))).alias("model_id"),
        F.when(key % 4 == 0, F.lit("active")).when(key % 97 == 0, F.lit("broken")).otherwise("approved").alias("status"),
    )
    active = table(spark, folder, "orders").select(F.concat(F.lit("m"), (F.col("o_custkey") * 3).cast("string")).alias("model_id")).distinct()
    bad = contracts.status_violations(models).select(F.lit("invalid_row").alias("problem"), "model_id", "status")
    unknown = contracts.unknown_active(active, models).select(F.lit("unknown_active").alias("problem"), "model_id", F.lit(None).cast("string").alias("status"))
    return final(bad.unionByName(unknown))


REGISTRY_SQL = """
WITH m AS (SELECT CASE WHEN c_custkey % 101 <> 0 THEN 'm' || c_custkey END AS model_id, CASE WHEN c_custkey % 4 = 0 THEN 'active' WHEN c_custkey % 97 = 0 THEN 'broken' ELSE 'approved' END AS status FROM customer)
SELECT 'invalid_row' AS problem, model_id, status FROM m WHERE model_id IS NULL OR status = 'broken'
UNION ALL SELECT DISTINCT 'unknown_active', 'm' || (o_custkey * 3), NULL FROM orders WHERE 'm' || (o_custkey * 3) NOT IN (SELECT model_id FROM m WHERE model_id IS NOT NULL)"""


def event_rows(spark, folder):
    log = events(spark, folder)
    row = lifecycle.event_row(
        F.col("event_type"), F.concat(F.lit("m"), F.col("user_id").cast("string")), F.lit("operator"), F.lit("from log"), F.col("ts").cast("timestamp")
    )
    return final(log.select(*row))


EVENT_ROWS_SQL = """
WITH e AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events)
SELECT stamp || '::' || event_type || '::m' || user_id AS event_id, stamp AS "timestamp", event_type, 'm' || user_id AS model_id, 'operator' AS actor, 'from log' AS reason FROM e"""

QUERIES = {
    "lifecycle_null_registry": null_registry,
    "monitor_null_route": null_route,
    "monitor_latency_summary": latency_summary,
    "monitor_access_statistics": access_statistics,
    "monitor_latest": latest_events,
    "monitor_latest_per_key": latest_per_type,
    "monitor_window_metrics": window_metrics,
    "monitor_p95_alarm": p95_alarm,
    "monitor_error_alarm": error_alarm,
    "logs_report_lines": report_lines,
    "logs_cold_starts": cold,
    "lifecycle_model_state": model_state,
    "lifecycle_transition_audit": transition_audit,
    "lifecycle_rollback_target": rollback,
    "lifecycle_resolve_active": resolve,
    "lifecycle_upsert": upsert,
    "lifecycle_registry_checks": registry_checks,
    "lifecycle_event_rows": event_rows,
}
ORACLE = {
    "lifecycle_null_registry": NULL_REGISTRY_SQL,
    "monitor_null_route": NULL_ROUTE_SQL,
    "monitor_latency_summary": LATENCY_SQL,
    "monitor_access_statistics": ACCESS_SQL,
    "monitor_latest": LATEST_SQL,
    "monitor_latest_per_key": LATEST_TYPE_SQL,
    "monitor_window_metrics": WINDOW_SQL,
    "monitor_p95_alarm": P95_SQL,
    "monitor_error_alarm": ERROR_SQL,
    "logs_report_lines": REPORT_SQL,
    "logs_cold_starts": COLD_SQL,
    "lifecycle_model_state": MODEL_STATE_SQL,
    "lifecycle_transition_audit": AUDIT_SQL,
    "lifecycle_rollback_target": ROLLBACK_SQL,
    "lifecycle_resolve_active": RESOLVE_SQL,
    "lifecycle_upsert": UPSERT_SQL,
    "lifecycle_registry_checks": REGISTRY_SQL,
    "lifecycle_event_rows": EVENT_ROWS_SQL,
}
