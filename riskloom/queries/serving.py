"""Requests, scorecards, contribution lists and responses; customers with their order counts are the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions.text import number
from riskloom.operators import scoring
from riskloom.queries.common import final, table, text
from riskloom.sources.requests import parse_requests
from riskloom.streaming.scoring import rejected_requests, score_requests

# Input fields as SQL over (k = customer key, o = number of orders); both engines read the same expressions.
INPUTS = {
    "age": "CASE WHEN k % 19 = 0 THEN '' ELSE CAST(18 + (k % 40) * 2 AS STRING) END",
    "sex": "CASE WHEN k % 2 = 0 THEN 'male' ELSE 'female' END",
    "sbp": "CAST(90 + o * 5 AS STRING)",
    "dbp": "CAST(35 + k % 120 AS STRING)",
    "bmi": "CASE WHEN k % 6 <> 0 THEN concat(k % 70, '.', k % 10) END",
    "egfr": "CAST(k % 130 AS STRING)",
    "uacr": "CAST(k % 400 AS STRING)",
    "hba1c": "concat(3 + k % 11, '.', (k % 3) * 4)",
    "scr": "concat(k % 7, '.', k % 10)",
    "potassium": "CASE WHEN k % 23 = 0 THEN 'n/a' ELSE concat(k % 5, '.', k % 10) END",
    "dm": "CASE k % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN ' Y ' WHEN 4 THEN 'unknown' END",
    "htn": "CASE k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END",
    "cvd": "CASE k % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'no' END",
    "proteinuria_flag": "CASE k % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'yes' END",
    "sc": "concat(k % 6, '.', (k % 4) * 2)",
    "hemo": "CASE WHEN k % 8 <> 0 THEN concat(5 + k % 12, '.', k % 10) END",
    "pcv": "CAST(20 + k % 35 AS STRING)",
    "bu": "CAST(10 + o * 12 AS STRING)",
    "al": "CAST(k % 6 AS STRING)",
    "su": "CAST(k % 5 AS STRING)",
    "sg": "concat('1.0', 10 + (k % 4) * 5)",
    "rbcc": "concat(2 + k % 5, '.', k % 10)",
    "bgr": "CAST(60 + k % 400 AS STRING)",
    "cad": "CASE WHEN k % 7 = 0 THEN 'yes' ELSE 'no' END",
    "ane": "CASE WHEN k % 9 = 0 THEN 'yes' ELSE 'no' END",
    "pe": "CASE WHEN k % 10 = 0 THEN 'yes' ELSE 'no' END",
    "appet": "CASE WHEN k % 4 = 1 THEN 'poor' ELSE 'good' END",
    "pc": "CASE WHEN k % 5 = 2 THEN 'abnormal' ELSE 'normal' END",
    "rbc": "CASE WHEN k % 5 = 3 THEN 'abnormal' ELSE 'normal' END",
}


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("o"))
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).join(counts, "k", "left")
    return base.select("k", F.coalesce("o", F.lit(0)).alias("o")).select("k", *[F.expr(e).alias(n) for n, e in INPUTS.items()])


INPUT_SQL = (
    "x AS (SELECT k, coalesce(o, 0) AS o FROM (SELECT c_custkey AS k FROM customer) LEFT JOIN (SELECT o_custkey AS k, count(*) AS o FROM orders GROUP BY 1) USING (k)), i AS (SELECT k, "
    + ", ".join(f"{e} AS {n}" for n, e in INPUTS.items())
    + " FROM x)"
)


def num(name: str) -> str:
    return f"TRY_CAST({name} AS DOUBLE)"


def yes(name: str) -> str:
    return f"coalesce(lower(trim({name})) IN {fixed.YES_WORDS}, false)"


def d(value: float) -> str:
    return f"{value!r}::DOUBLE"


def clipped(expression: str, low: float | None, high: float | None) -> str:
    if low is not None:
        expression = f"(CASE WHEN {expression} < {d(low)} THEN {d(low)} ELSE {expression} END)"
    if high is not None:
        expression = f"(CASE WHEN {expression} > {d(high)} THEN {d(high)} ELSE {expression} END)"
    return expression


def card_sql(base: float, items) -> str:
    total = d(base)
    for p in items:
        if isinstance(p, fixed.Word):
            total += f" + (CASE WHEN {p.feature} = '{p.word}' THEN {d(p.weight)} ELSE 0.0::DOUBLE END)"
        else:
            value = f"(({num(p.feature)} - {d(p.centre)}) * {d(p.factor)} / {d(p.divisor)})"
            total += f" + coalesce({clipped(value, p.low, p.high)} * {p.sign}, 0.0::DOUBLE)"
    # Half up on the exact binary value; only multiples of 1/16 can be exact halves of a thousandth.
    rounded = f"list_transform([{total}], lambda v: CASE WHEN v * 16 = floor(v * 16) THEN round(v, 3) ELSE printf('%.3f', v)::DOUBLE END)[1]"
    return f"least(greatest({rounded}, 0.02::DOUBLE), 0.98::DOUBLE)"


def scorecards(spark, folder):
    df = inputs(spark, folder)
    f = scoring.fields(df)
    scored = df.select("k", scoring.clinical_score(f).alias("clinical"), scoring.research_score(f).alias("research"))
    return final(
        scored.select(
            "*",
            scoring.band(F.col("clinical")).alias("clinical_label"),
            scoring.band(F.col("research"), ("high", "mid", "low")).alias("research_band"),
        )
    )


SCORECARDS_SQL = f"""
WITH {INPUT_SQL}, s AS (SELECT k, {card_sql(fixed.CLINICAL_BASE, fixed.CLINICAL_SCORECARD)} AS clinical, {card_sql(fixed.RESEARCH_BASE, fixed.RESEARCH_SCORECARD)} AS research FROM i)
SELECT *, CASE WHEN clinical >= 0.7 THEN 'high_risk' WHEN clinical >= 0.4 THEN 'moderate_risk' ELSE 'lower_risk' END AS clinical_label,
  CASE WHEN research >= 0.7 THEN 'high' WHEN research >= 0.4 THEN 'mid' ELSE 'low' END AS research_band FROM s"""


def _items(df: DataFrame, items) -> DataFrame:
    return df.select("k", F.posexplode(items).alias("place", "item")).select("k", (F.col("place") + 1).alias("place"), "item.*")


def research_contributions(spark, folder):
    df = inputs(spark, folder)
    return final(_items(df, scoring.research_contributions(scoring.fields(df))))


def clinical_contributions(spark, folder):
    df = inputs(spark, folder)
    return final(_items(df, scoring.clinical_contributions(scoring.fields(df))))


def contribution_sql(terms, flags, fallback, source: str = "i") -> str:
    parts = []
    for place, t in enumerate(terms):
        value = f"(({num(t.feature)} - {d(t.centre)}) / {d(t.scale)})"
        parts.append(
            f"SELECT k, {place} AS ord, '{t.feature}' AS feature, {text(t.message)} AS message, {clipped(value, t.low, t.high)} * {t.sign} AS v FROM {source}"
        )
    for place, f in enumerate(flags, start=len(terms)):
        said = yes(f.feature) if f.word == "yes" else f"lower(trim({f.feature})) = '{f.word}'"
        parts.append(f"SELECT k, {place}, '{f.feature}', {text(f.message)}, {d(f.weight)} FROM {source} WHERE {said}")
    return f"""raw AS ({" UNION ALL ".join(parts)}),
found AS (SELECT k, ord, feature, message, printf('%.4f', v)::DOUBLE AS contribution FROM raw WHERE v <> 0),
allitems AS (SELECT * FROM found UNION ALL SELECT k, 0, '{fallback.feature}', {text(fallback.message)}, {d(fallback.weight)} FROM {source} WHERE k NOT IN (SELECT k FROM found)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(contribution) DESC, ord) AS place FROM allitems)"""


RESEARCH_SQL = f"WITH {INPUT_SQL}, {contribution_sql(fixed.RESEARCH_TERMS, fixed.RESEARCH_FLAGS, fixed.RESEARCH_FALLBACK)} SELECT k, place, feature, message, contribution + 0.0 AS contribution FROM ranked WHERE place <= 6"
CLINICAL_SQL = f"WITH {INPUT_SQL}, {contribution_sql(fixed.CLINICAL_TERMS, fixed.CLINICAL_FLAGS, fixed.CLINICAL_FALLBACK)} SELECT k, place, feature, message, contribution + 0.0 AS contribution FROM ranked WHERE place <= 6"


def messages(spark, folder):
    df = inputs(spark, folder)
    f = scoring.fields(df)
    both = _items(df, scoring.threshold_messages(f, fixed.CLINICAL_MESSAGES)).withColumn("mode", F.lit("clinical"))
    return final(
        both.unionByName(_items(df, scoring.threshold_messages(f, fixed.RESEARCH_MESSAGES)).withColumn("mode", F.lit("research")))
    )


def _messages_sql(mode: str, rules) -> str:
    parts = []
    for place, (feature, sign, bound, name, message, weight) in enumerate(rules):
        test = f"{feature} = '{bound}'" if sign == "=" else f"{num(feature)} {sign} {d(float(bound))}"
        parts.append(f"SELECT k, {place} AS ord, '{name}' AS feature, {text(message)} AS message, {d(float(weight))} AS contribution FROM i WHERE {test}")
    return f"SELECT k, place, feature, message, contribution, '{mode}' AS mode FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS place FROM ({' UNION ALL '.join(parts)})) WHERE place <= 5"


MESSAGES_SQL = f"WITH {INPUT_SQL} {_messages_sql('clinical', fixed.CLINICAL_MESSAGES)} UNION ALL {_messages_sql('research', fixed.RESEARCH_MESSAGES)}"


def translation(spark, folder):
    df = inputs(spark, folder)
    f = scoring.fields(df)
    view = scoring.translated(f)
    columns = [number(c).alias(n) if n in ("age", "sc", "pot") else c.alias(n) for n, c in ((n, view(n)) for n in ("age", "sc", "pot", "dm", "htn", "hemo", "cad"))]
    return final(df.select("k", *columns, F.array_join(scoring.translation_notes(f), " ").alias("notes")))


def _word(name: str) -> str:
    return f"CASE WHEN lower(trim({name})) IN {fixed.YES_WORDS} THEN 'yes' WHEN lower(trim({name})) IN {fixed.NO_WORDS} THEN 'no' ELSE nullif(lower(trim({name})), '') END"


TRANSLATION_SQL = f"""WITH {INPUT_SQL}
SELECT k, {num('age')} AS age, {num('scr')} AS sc, {num('potassium')} AS pot, {_word('dm')} AS dm, {_word('htn')} AS htn, NULL::VARCHAR AS hemo, NULL::VARCHAR AS cad,
  concat_ws(' ', {", ".join(f"CASE WHEN {n} IS NOT NULL THEN {text(t)} END" for n, t in fixed.TRANSLATION_NOTES.items())}) AS notes FROM i"""


def ranges(spark, folder):
    return final(scoring.range_states(inputs(spark, folder), ["k"]))


RANGES_SQL = f"WITH {INPUT_SQL} " + " UNION ALL ".join(
    f"SELECT k, '{n}' AS field, {num(n)} AS value, CASE WHEN {num(n)} IS NULL THEN 'blank' WHEN {num(n)} < {d(lo)} OR {num(n)} > {d(hi)} THEN 'out_of_range' ELSE 'in_range' END AS state FROM i"
    for n, (lo, hi) in fixed.CLINICAL_RANGES.items()
)


def research_ranges(spark, folder):
    """Research fields; those that no input has are blank."""
    return final(scoring.range_states(inputs(spark, folder), ["k"], fixed.RESEARCH_RANGES))


RESEARCH_RANGES_SQL = f"WITH {INPUT_SQL} " + " UNION ALL ".join(
    f"SELECT k, '{n}' AS field, {num(n)} AS value, CASE WHEN {num(n)} IS NULL THEN 'blank' WHEN {num(n)} < {d(lo)} OR {num(n)} > {d(hi)} THEN 'out_of_range' ELSE 'in_range' END AS state FROM i"
    if n in INPUTS
    else f"SELECT k, '{n}', NULL::DOUBLE, 'blank' FROM i"
    for n, (lo, hi) in fixed.RESEARCH_RANGES.items()
)


def completeness(spark, folder):
    df = inputs(spark, folder)
    filled, state = scoring.completeness(scoring.fields(df), fixed.CLINICAL_FEATURES)
    return final(df.select("k", filled.alias("filled"), F.lit(len(fixed.CLINICAL_FEATURES)).alias("total"), state.alias("state")))


_FILLED = " + ".join(f"(coalesce(trim({n}), '') <> '')::INT" for n in fixed.CLINICAL_FEATURES)
COMPLETENESS_SQL = f"""WITH {INPUT_SQL}, f AS (SELECT k, {_FILLED} AS filled FROM i)
SELECT k, filled::BIGINT AS filled, 14::BIGINT AS total, CASE WHEN filled = 0 THEN 'empty' WHEN filled >= 14 THEN 'complete' ELSE 'partial' END AS state FROM f"""

CODES = {"BUILDING": 0, "MACHINERY": 1, "unknown": 2}


def encoding(spark, folder):
    raw = F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))
    return final(
        table(spark, folder, "customer")
        .select(F.col("c_mktsegment").alias("segment"), scoring.encoded(raw, CODES).alias("code"))
        .groupBy("segment", "code")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


ENCODING_SQL = """
SELECT c_mktsegment AS segment, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 0.0::DOUBLE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS code,
  count(*) AS row_count FROM customer GROUP BY 1, 2"""


def probabilities(spark, folder):
    decision = F.col("c_acctbal") / 2000.0
    squashed = scoring.squash(decision)
    return final(
        table(spark, folder, "customer").select(
            "c_custkey",
            squashed.alias("squashed"),
            scoring.probability(decision).alias("clamped"),
            scoring.band(squashed).alias("label"),
        )
    )


PROBABILITIES_SQL = """
SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal / 2000.0::DOUBLE))), 6) AS squashed, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 2000.0::DOUBLE)), 6) AS clamped,
  CASE WHEN 1 / (1 + exp(-(c_acctbal / 2000.0::DOUBLE))) >= 0.7 THEN 'high_risk' WHEN 1 / (1 + exp(-(c_acctbal / 2000.0::DOUBLE))) >= 0.4 THEN 'moderate_risk' ELSE 'lower_risk' END AS label
FROM customer"""

# --- Responses of other servers -------------------------------------------------

RESPONSE = """concat('{"', CASE k % 3 WHEN 0 THEN 'risk_score' WHEN 1 THEN 'score' ELSE 'other' END, '": 0.', 100 + k % 900,
 CASE WHEN k % 2 = 0 THEN ', "label": "seen"' ELSE '' END, ', "version": "v', k % 4, '", "timestamp": "t", "explanation": [',
 '{"feature": "f', k % 5, '", "message": "Lower value", "contribution": ', CASE WHEN k % 2 = 0 THEN '-0.25' ELSE '"n/a"' END, '}, {"message": "up"}, {"feature": "g"}]}')"""


def responses(spark, folder):
    df = table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).withColumn("body", F.expr(RESPONSE))
    read = df.select("k", *scoring.normalized_response(F.col("body")))
    return final(read.select("k", "risk_score", "prediction_label", "model_version", "notes", F.posexplode("explanation").alias("place", "item")).select("*", "item.*").drop("item"))


RESPONSES_SQL = """
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 2 THEN 0.0::DOUBLE ELSE ((100 + c_custkey % 900) / 1000.0)::DOUBLE END AS risk_score,
  CASE WHEN c_custkey % 2 = 0 THEN 'seen' ELSE 'unknown' END AS prediction_label, 'v' || (c_custkey % 4) AS model_version FROM customer)
SELECT k, risk_score, prediction_label, model_version, 'Prediction completed successfully.' AS notes, place::BIGINT AS place,
  CASE place WHEN 0 THEN 'f' || (k % 5) WHEN 1 THEN 'feature_2' ELSE 'g' END AS feature,
  CASE place WHEN 0 THEN 'Lower value' WHEN 1 THEN 'up' ELSE 'No explanation note returned.' END AS message,
  CASE place WHEN 0 THEN CASE WHEN k % 2 = 0 THEN -0.25::DOUBLE ELSE -0.16::DOUBLE END WHEN 1 THEN 0.13::DOUBLE ELSE 0.1::DOUBLE END AS contribution,
  CASE place WHEN 0 THEN 'negative' ELSE 'positive' END AS direction
FROM r, generate_series(0, 2) g(place)"""

# --- Requests -------------------------------------------------------------------

MODE = "CASE event_type WHEN 'click' THEN '\"mode\": \" Clinical \", ' WHEN 'view' THEN '' WHEN 'purchase' THEN '\"mode\": \"research\", ' WHEN 'signup' THEN '\"mode\": \"batch\", ' ELSE '\"mode\": null, ' END"
ENVELOPE = "CASE event_id % 4 WHEN 0 THEN 'inputs' WHEN 1 THEN 'payload' WHEN 2 THEN 'context' ELSE 'inputs' END"
FIELDS = "concat('{\"age\": ', user_id % 90, ', \"scr\": ', event_id % 6, '.5, \"sc\": \"', event_id % 5, '.4\", \"dm\": \"', CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END, '\", \"egfr\": ', user_id, ', \"hemo\": null}')"
BODY = f"CASE WHEN event_id % 50 = 0 THEN '{{broken' WHEN event_id % 50 = 1 THEN '' ELSE concat('{{', {MODE}, '\"n\": 1, \"', {ENVELOPE}, '\": ', {FIELDS}, '}}') END"


def requests(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("text", F.expr(BODY))
    coded = F.col("event_id") % 3 == 0
    return events.select(
        "event_id",
        F.when(coded, F.base64(F.col("text").cast("binary"))).otherwise(F.col("text")).alias("body"),
        coded.alias("is_base64"),
    )


def parsed_requests(spark, folder):
    parsed = parse_requests(requests(spark, folder), "body", "is_base64")
    get = scoring.map_fields("inputs")
    return final(parsed.select("event_id", "mode", "rejection", get("age").alias("age"), get("sc").alias("sc"), get("dm").alias("dm"), get("hemo").alias("hemo")))


PARSED = """p AS (SELECT *, event_id % 50 = 0 AS broken, event_id % 50 = 1 AS blank FROM events),
q AS (SELECT *, CASE WHEN broken OR blank OR event_type IN ('view') THEN 'research' WHEN event_type = 'click' THEN 'clinical' WHEN event_type = 'purchase' THEN 'research' WHEN event_type = 'signup' THEN 'batch' ELSE 'none' END AS m,
  NOT broken AND NOT blank AND event_id % 4 <> 2 AS has_inputs FROM p),
r AS (SELECT *, CASE WHEN broken THEN 'invalid_json' WHEN NOT has_inputs THEN 'missing_inputs' WHEN m NOT IN ('research', 'clinical') THEN 'unsupported_mode' END AS rejection FROM q)"""

PARSED_SQL = f"""WITH {PARSED}
SELECT event_id, CASE WHEN broken THEN NULL ELSE m END AS mode, rejection, CASE WHEN has_inputs THEN (user_id % 90)::VARCHAR END AS age, CASE WHEN has_inputs THEN (event_id % 5) || '.4' END AS sc,
  CASE WHEN has_inputs THEN CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END END AS dm, NULL::VARCHAR AS hemo FROM r"""


def rejected(spark, folder):
    found = rejected_requests(requests(spark, folder), "body", ["event_id"], "is_base64")
    return final(found.groupBy("rejection").agg(F.count(F.lit(1)).alias("row_count"), F.min("event_id").alias("first_event")))


REJECTED_SQL = f"WITH {PARSED} SELECT rejection, count(*) AS row_count, min(event_id) AS first_event FROM r WHERE rejection IS NOT NULL GROUP BY 1"


def scored_requests(spark, folder):
    scored = score_requests(requests(spark, folder), "body", ["event_id"], "is_base64")
    return final(
        scored.select("event_id", "risk_score", "prediction_label", "model_version", "serving_route", "notes", F.size("explanation").alias("items"), F.col("explanation")[0]["feature"].alias("first_feature"))
    )


_RI = "i AS (SELECT event_id AS k, m, (user_id % 90)::VARCHAR AS age, (event_id % 6) || '.5' AS scr, (event_id % 5) || '.4' AS sc, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS dm, user_id::VARCHAR AS egfr, " + ", ".join(
    f"NULL::VARCHAR AS {n}" for n in ("htn", "cad", "pe", "ane", "appet", "pc", "rbc", "al", "su", "bu", "bgr", "hemo", "pcv", "rbcc", "sg", "uacr", "hba1c", "sbp", "cvd", "proteinuria_flag")
) + " FROM r WHERE rejection IS NULL)"
SCORED_SQL = f"""WITH {PARSED}, {_RI},
ir AS (SELECT * FROM i WHERE m = 'research'), ic AS (SELECT * FROM i WHERE m = 'clinical'), tc AS (SELECT * REPLACE (scr AS sc) FROM ic),
a AS (WITH {contribution_sql(fixed.RESEARCH_TERMS, fixed.RESEARCH_FLAGS, fixed.RESEARCH_FALLBACK, "ir")} SELECT k, count(*) FILTER (place <= 6) AS items, max(feature) FILTER (place = 1) AS first_feature FROM ranked GROUP BY 1),
b AS (WITH {contribution_sql(fixed.CLINICAL_TERMS, fixed.CLINICAL_FLAGS, fixed.CLINICAL_FALLBACK, "ic")} SELECT k, count(*) FILTER (place <= 6) AS items, max(feature) FILTER (place = 1) AS first_feature FROM ranked GROUP BY 1),
s AS (SELECT k, {card_sql(fixed.RESEARCH_BASE, fixed.RESEARCH_SCORECARD)} AS risk_score, 'research' AS m, {text(fixed.RESEARCH_NOTE)} AS notes FROM ir
 UNION ALL SELECT k, {card_sql(fixed.RESEARCH_BASE, fixed.RESEARCH_SCORECARD)}, 'clinical', {text(fixed.CLINICAL_NOTE + " " + fixed.TRANSLATION_NOTES["egfr"])} FROM tc)
SELECT k AS event_id, risk_score, CASE WHEN risk_score >= 0.7 THEN 'high_risk' WHEN risk_score >= 0.4 THEN 'moderate_risk' ELSE 'lower_risk' END AS prediction_label,
  'scorecard::' || m AS model_version, '/predict/' || m AS serving_route, notes, items, first_feature
FROM s JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) USING (k)"""

ODD_NUMBER = "CASE event_id % 7 WHEN 1 THEN '\"abc\"' WHEN 2 THEN '\" \"' WHEN 3 THEN '\"\"' WHEN 4 THEN 'null' WHEN 5 THEN '[1]' ELSE '1.5' END"
ODD_BODY = f"concat('{{\"mode\": \"', CASE WHEN user_id % 2 = 0 THEN 'clinical' ELSE 'research' END, '\", \"inputs\": {{\"wbcc\": \"many\", \"hemo\": ', CASE WHEN event_id % 3 = 0 THEN '\"n/a\"' ELSE '12' END, ', \"sc\": ', {ODD_NUMBER}, ', \"scr\": ', {ODD_NUMBER}, '}}}}')"


def invalid_numbers(spark, folder):
    """Requests by route and refused number field; fields of the other route and fields that are no numbers don't matter."""
    events = table(spark, folder, "events").withColumn("body", F.expr(ODD_BODY))
    parsed = parse_requests(events, "body")
    return final(parsed.groupBy("mode", "rejection", "rejected_field").agg(F.count(F.lit(1)).alias("row_count"), F.min("event_id").alias("first_event")))


INVALID_NUMBERS_SQL = """
WITH p AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'clinical' ELSE 'research' END AS mode, event_id % 7 IN (1, 2, 5) AS odd, event_id % 3 = 0 AS words FROM events),
q AS (SELECT event_id, mode, CASE WHEN mode = 'clinical' AND odd THEN 'scr' WHEN mode = 'research' AND odd THEN 'sc' WHEN mode = 'research' AND words THEN 'hemo' END AS rejected_field FROM p)
SELECT mode, CASE WHEN rejected_field IS NOT NULL THEN 'invalid_number' END AS rejection, rejected_field, count(*) AS row_count, min(event_id) AS first_event FROM q GROUP BY 1, 2, 3"""

QUERIES = {
    "score_scorecards": scorecards,
    "score_probabilities": probabilities,
    "score_research_contributions": research_contributions,
    "score_clinical_contributions": clinical_contributions,
    "score_threshold_messages": messages,
    "score_clinical_translation": translation,
    "score_field_ranges": ranges,
    "score_research_ranges": research_ranges,
    "score_completeness": completeness,
    "score_category_codes": encoding,
    "score_normalized_responses": responses,
    "requests_parsed": parsed_requests,
    "requests_rejected": rejected,
    "requests_scored": scored_requests,
    "requests_invalid_number": invalid_numbers,
}
ORACLE = {
    "score_scorecards": SCORECARDS_SQL,
    "score_probabilities": PROBABILITIES_SQL,
    "score_research_contributions": RESEARCH_SQL,
    "score_clinical_contributions": CLINICAL_SQL,
    "score_threshold_messages": MESSAGES_SQL,
    "score_clinical_translation": TRANSLATION_SQL,
    "score_field_ranges": RANGES_SQL,
    "score_research_ranges": RESEARCH_RANGES_SQL,
    "score_completeness": COMPLETENESS_SQL,
    "score_category_codes": ENCODING_SQL,
    "score_normalized_responses": RESPONSES_SQL,
    "requests_parsed": PARSED_SQL,
    "requests_rejected": REJECTED_SQL,
    "requests_scored": SCORED_SQL,
    "requests_invalid_number": INVALID_NUMBERS_SQL,
}
