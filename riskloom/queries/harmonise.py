"""Column alignment, token parsing, representation audits, repair rules and repairs.

The part table plays two sources: source A renders its columns as numbers and
words, source B as codes, bins and spreadsheet-damaged tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.fixed import (
    DIRECTION_NOTES,
    DROPPED_REASON,
    EXACT_MATCH_NOTE,
    RULE_NOTES,
    SPECIAL_PAIR_NOTE,
    TYPE_NOTES,
    UNMATCHED_NOTE,
    FeatureGroups,
)
from riskloom.functions import text as X
from riskloom.operators import align, audit, contracts
from riskloom.plans.harmonise import harmonise
from riskloom.queries.common import final, table, text

GROUPS = FeatureGroups(
    low_risk_binary=("flag",),
    mapped_binary=("state",),
    spreadsheet_risk=("size", "level"),
    interval_risk=("amount", "size"),
    stage_like=("level",),
    repairable_spreadsheet=("size",),
)
FEATURES = ("flag", "state", "level", "amount", "size", "kind", "code")

# --- Column alignment -----------------------------------------------------------

PAIRS = {"small ring": "red widget"}


def _catalogues(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, folder, "part")
    left = parts.filter("p_size <= 48").select(F.initcap("p_name").alias("column"))
    right = parts.filter("p_size > 48").select(F.initcap("p_name").alias("column"))
    return left.distinct(), right.distinct()


CATALOGUES = """
a AS (SELECT DISTINCT p_name AS c FROM part WHERE p_size <= 48), b AS (SELECT DISTINCT p_name AS c FROM part WHERE p_size > 48)"""


def candidates(spark, folder):
    left, right = _catalogues(spark, folder)
    lower = [d.select(F.lower("column").alias("column")) for d in (left, right)]
    return final(align.candidates(lower[0], lower[1], PAIRS))


CANDIDATES_SQL = f"""
WITH {CATALOGUES},
n AS (SELECT a.c AS x, b.c AS y FROM a FULL JOIN b ON a.c = b.c),
sp AS (SELECT 'small ring' AS x, 'red widget' AS y),
r AS (SELECT x, y, 1 AS k FROM n WHERE x IS NOT NULL AND y IS NOT NULL
  UNION ALL SELECT sp.x, sp.y, 2 FROM sp WHERE sp.x IN (SELECT c FROM a) AND sp.y IN (SELECT c FROM b)
  UNION ALL SELECT x, y, 3 FROM n WHERE y IS NULL AND x NOT IN (SELECT x FROM sp)
  UNION ALL SELECT x, y, 4 FROM n WHERE x IS NULL AND y NOT IN (SELECT y FROM sp))
SELECT coalesce(x, '') AS source_a_column, coalesce(y, '') AS source_b_column,
  CASE WHEN k = 2 THEN 'blood_pressure_candidate' ELSE trim(regexp_replace(lower(coalesce(x, y)), '[^a-z0-9]+', '_', 'g'), '_') END AS unified_name,
  CASE k WHEN 1 THEN 'yes' WHEN 2 THEN 'uncertain' ELSE 'no_shared_counterpart' END AS same_meaning,
  CASE k WHEN 1 THEN 'unknown' WHEN 2 THEN 'uncertain' ELSE 'not_applicable' END AS same_unit,
  CASE WHEN k <= 2 THEN 'pending_review' ELSE 'no' END AS keep_for_shared_model,
  CASE k WHEN 1 THEN {text(EXACT_MATCH_NOTE)} WHEN 2 THEN {text(SPECIAL_PAIR_NOTE.format(a="a", b="b"))} WHEN 3 THEN {text(UNMATCHED_NOTE.format(source="a"))} ELSE {text(UNMATCHED_NOTE.format(source="b"))} END AS notes,
  CASE WHEN k <= 2 THEN 'yes' ELSE 'no' END AS manual_review_required
FROM r"""


def dropped(spark, folder):
    left, right = _catalogues(spark, folder)
    return final(align.dropped(left, right))


DROPPED_SQL = f"""
WITH {CATALOGUES}
SELECT array_to_string(list_transform(string_split(c, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS "column", {text(DROPPED_REASON)} AS reason
FROM a WHERE c NOT IN (SELECT c FROM b)"""


def mapping_violations(spark, folder):
    key = F.col("p_partkey")
    mapping = table(spark, folder, "part").select(
        F.when(key % 11 == 0, F.lit(" ")).otherwise(F.concat("p_name", F.lit(" "), (key % 40).cast("string"))).alias(align.LEFT),
        F.concat("p_brand", F.lit(" "), "p_size").alias(align.RIGHT),
        key.cast("string").alias("unified_name"),
        F.when(key % 2 == 0, F.lit(" YES ")).otherwise("no").alias("keep_for_shared_model"),
        F.when(key % 17 == 0, F.lit("Yes")).otherwise("no").alias("manual_review_required"),
    )
    return final(contracts.mapping_violations(mapping, align.LEFT, align.RIGHT))


MAPPING_SQL = """
WITH m AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name || ' ' || (p_partkey % 40) END AS l, p_brand || ' ' || p_size AS r, p_partkey::VARCHAR AS u, p_partkey AS k
           FROM part WHERE p_partkey % 2 = 0)
SELECT 'open_review' AS violation, u AS detail FROM m WHERE k % 17 = 0
UNION ALL SELECT 'blank_source_a_column', u FROM m WHERE trim(l) = ''
UNION ALL SELECT 'duplicate_source_a_column', l FROM m GROUP BY l HAVING count(*) > 1
UNION ALL SELECT 'duplicate_source_b_column', r FROM m GROUP BY r HAVING count(*) > 1"""

SHARED = [
    ("c_custkey", "s_suppkey", "key"),
    ("c_nationkey", "s_nationkey", "nation"),
    ("c_acctbal", "s_acctbal", "balance"),
]


def aligned(spark, folder):
    a = align.aligned(table(spark, folder, "customer"), SHARED, 0, None).withColumn("side", F.lit("a"))
    b = align.aligned(table(spark, folder, "supplier"), SHARED, 1, None).withColumn("side", F.lit("b"))
    both = a.unionByName(b)
    return final(
        both.groupBy("side", "nation").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("key").alias("key_sum"), F.avg("balance").alias("mean_balance")
        )
    )


ALIGNED_SQL = """
SELECT side, nation::BIGINT AS nation, count(*) AS row_count, sum(key)::BIGINT AS key_sum, round(avg(balance), 6) AS mean_balance
FROM (SELECT 'a' AS side, c_nationkey AS nation, c_custkey AS key, c_acctbal AS balance FROM customer
      UNION ALL SELECT 'b', s_nationkey, s_suppkey, s_acctbal FROM supplier) GROUP BY 1, 2"""

# --- Tokens ---------------------------------------------------------------------

MONTHS = ("Jan", "Feb", "Sept", "Xyz", "may", "Jun", "DEC")


def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    low = F.floor(q / 10) * 10
    bins = (
        F.when(q < 10, F.lit("<10"))
        .when(q < 40, F.concat(low.cast("string"), F.lit("   -  "), (low + 10).cast("string"), F.lit(".50 ")))
        .otherwise(F.lit(" ≥  40"))
    )
    months = F.concat(n.cast("string"), F.lit("-"), F.get(F.array(*[F.lit(m) for m in MONTHS]), n - 1))
    other = F.concat(F.when(n == 1, F.lit("<= ")).when(n == 2, F.lit("> ")).otherwise(F.lit("x ")), q.cast("int").cast("string"))
    return table(spark, folder, "lineitem").select(F.explode(F.array(bins, months, other)).alias("raw"))


TOKENS = """
tok AS (SELECT unnest([
  CASE WHEN l_quantity < 10 THEN '<10' WHEN l_quantity < 40 THEN (floor(l_quantity / 10) * 10)::INT || '   -  ' || (floor(l_quantity / 10) * 10 + 10)::INT || '.50 ' ELSE ' ≥  40' END,
  l_linenumber || '-' || ['Jan', 'Feb', 'Sept', 'Xyz', 'may', 'Jun', 'DEC'][l_linenumber],
  CASE l_linenumber WHEN 1 THEN '<= ' WHEN 2 THEN '> ' ELSE 'x ' END || l_quantity::INT]) AS raw FROM lineitem),
cnt AS (SELECT raw, count(*) AS row_count FROM tok GROUP BY 1),
norm AS (SELECT raw, row_count, regexp_replace(replace(replace(trim(raw), '≤', '<='), '≥', '>='), '\\s+', ' ', 'g') AS token FROM cnt)"""


def tokens(spark, folder):
    counts = token_rows(spark, folder).groupBy("raw").agg(F.count(F.lit(1)).alias("row_count"))
    raw = F.col("raw")
    parsed = counts.select(
        "raw",
        "row_count",
        X.token(raw).alias("token"),
        X.coarse_interval(raw).alias("coarse_interval"),
        X.coarse_spreadsheet_date(raw).alias("coarse_date"),
        X.strict_spreadsheet_date(raw).alias("strict_date"),
        X.interval(raw).alias("i"),
    )
    return final(parsed.select("*", "i.kind", "i.lower", "i.upper", "i.canonical").drop("i"))


TOKENS_SQL = rf"""
WITH {TOKENS},
p AS (SELECT *, regexp_extract(token, '^(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)$', 1) AS lo, regexp_extract(token, '^(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)$', 2) AS hi,
        regexp_extract(token, '^<\s*(-?\d+(?:\.\d+)?)$', 1) AS lt, regexp_extract(token, '^>=\s*(-?\d+(?:\.\d+)?)$', 1) AS ge FROM norm)
SELECT raw, row_count, token,
  regexp_matches(trim(raw), '^(<|>|>=|<=|≥|≤)\s*[-+]?\d') OR regexp_matches(trim(raw), '^[-+]?\d+(\.\d+)?\s*-\s*[-+]?\d+(\.\d+)?$') AS coarse_interval,
  regexp_matches(lower(trim(raw)), '^\d+-(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)$') AS coarse_date,
  regexp_matches(token, '^\d{{1,2}}-[A-Za-z]{{3}}$') AS strict_date,
  CASE WHEN lo <> '' THEN 'range' WHEN lt <> '' THEN 'lt' WHEN ge <> '' THEN 'ge' END AS kind,
  CASE WHEN lo <> '' THEN TRY_CAST(lo AS DOUBLE) WHEN lt <> '' THEN '-Infinity'::DOUBLE WHEN ge <> '' THEN TRY_CAST(ge AS DOUBLE) END AS lower,
  CASE WHEN lo <> '' THEN TRY_CAST(hi AS DOUBLE) WHEN lt <> '' THEN TRY_CAST(lt AS DOUBLE) WHEN ge <> '' THEN 'Infinity'::DOUBLE END AS upper,
  CASE WHEN lo <> '' THEN printf('%g', TRY_CAST(lo AS DOUBLE)) || ' - ' || printf('%g', TRY_CAST(hi AS DOUBLE))
       WHEN lt <> '' THEN '< ' || printf('%g', TRY_CAST(lt AS DOUBLE)) WHEN ge <> '' THEN '>= ' || printf('%g', TRY_CAST(ge AS DOUBLE)) END AS canonical
FROM p"""

# --- Two sources ----------------------------------------------------------------


def sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, folder, "part")
    key, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    target = (key % 3 == 0).cast("int").alias("target")
    a = parts.select(
        "p_partkey",
        F.when(key % 13 != 0, F.when(size % 2 == 0, F.lit("yes")).otherwise("no")).alias("flag"),
        F.when(key % 3 == 0, F.lit("present")).otherwise("notpresent").alias("state"),
        (size % 6).cast("double").alias("level"),
        F.when(key % 7 != 0, price).alias("amount"),
        size.cast("double").alias("size"),
        F.col("p_type").alias("kind"),
        (size % 4).cast("string").alias("code"),
        target,
    )
    low = (F.floor(price / 20) * 20).cast("int")
    tens = (F.floor(size / 10) * 10).cast("int")
    level = size % 6
    b = parts.select(
        "p_partkey",
        (size % 2).cast("int").alias("flag"),
        (key % 3 == 0).cast("int").alias("state"),
        F.when(level == 0, F.lit("< 0")).when(level == 1, "1-Jan").when(level == 2, "2-Feb").when(level == 3, "3-Mar").otherwise("≥ 4").alias("level"),
        F.when(price < 920, F.lit("< 920")).when(price < 980, F.concat(low.cast("string"), F.lit(" - "), (low + 20).cast("string"))).otherwise("≥ 980").alias("amount"),
        F.when(size < 10, F.lit("< 10")).when(size < 20, "20-Dec").when(size < 40, F.concat(tens.cast("string"), F.lit(" - "), (tens + 10).cast("string"))).otherwise(">= 40").alias("size"),
        F.col("p_type").alias("kind"),
        (size % 4).cast("double").alias("code"),
        target,
    )
    return a, b


A_COLUMNS = {
    "flag": ("str", "CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END END"),
    "state": ("str", "CASE WHEN p_partkey % 3 = 0 THEN 'present' ELSE 'notpresent' END"),
    "level": ("float64", "(p_size % 6)::DOUBLE"),
    "amount": ("float64", "CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END"),
    "size": ("float64", "p_size::DOUBLE"),
    "kind": ("str", "p_type"),
    "code": ("str", "(p_size % 4)::VARCHAR"),
}
B_COLUMNS = {
    "flag": ("int64", "p_size % 2"),
    "state": ("int64", "(p_partkey % 3 = 0)::INT"),
    "level": ("str", "CASE p_size % 6 WHEN 0 THEN '< 0' WHEN 1 THEN '1-Jan' WHEN 2 THEN '2-Feb' WHEN 3 THEN '3-Mar' ELSE '≥ 4' END"),
    "amount": ("str", "CASE WHEN p_retailprice < 920 THEN '< 920' WHEN p_retailprice < 980 THEN (floor(p_retailprice / 20) * 20)::INT || ' - ' || (floor(p_retailprice / 20) * 20 + 20)::INT ELSE '≥ 980' END"),
    "size": ("str", "CASE WHEN p_size < 10 THEN '< 10' WHEN p_size < 20 THEN '20-Dec' WHEN p_size < 40 THEN (p_size // 10 * 10) || ' - ' || (p_size // 10 * 10 + 10) ELSE '>= 40' END"),
    "kind": ("str", "p_type"),
    "code": ("float64", "(p_size % 4)::DOUBLE"),
}


def _cells_sql(columns: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT p_partkey AS row, (p_partkey % 3 = 0)::INT AS target, '{f}' AS feature, '{t}' AS dtype, ({e})::VARCHAR AS raw, "
        + (
            f"CASE WHEN ({e}) = floor({e}) THEN ({e})::BIGINT::VARCHAR ELSE printf('%g', ({e})::DOUBLE) END"
            if t != "str"
            else f"trim({e})"
        )
        + " AS sig FROM part"
        for f, (t, e) in columns.items()
    )


VOCAB = {
    "binary_text_yes_no": "('yes', 'no')",
    "binary_text_present_absent": "('present', 'notpresent')",
    "binary_text_normal_abnormal": "('normal', 'abnormal')",
    "binary_text_good_poor": "('good', 'poor')",
}


def _coarse_sql(cells: str) -> str:
    words = " ".join(f"WHEN bool_and(lower(sig) IN {v}) THEN '{k}'" for k, v in VOCAB.items())
    return rf"""
SELECT feature, any_value(dtype) AS dtype, count(sig) AS nn, count(*) - count(sig) AS miss, count(DISTINCT sig) AS uniq,
  coalesce(bool_or(any_date), false) AS dates,
  CASE WHEN count(sig) = 0 THEN 'all_missing'
    WHEN any_value(dtype) <> 'str' AND bool_and(sig IN ('0', '1')) THEN 'binary_numeric'
    WHEN any_value(dtype) <> 'str' AND count(DISTINCT sig) <= 10 THEN 'numeric_low_cardinality'
    WHEN any_value(dtype) <> 'str' THEN 'numeric_continuous'
    WHEN bool_and(iv) THEN 'interval_text_bins' {words}
    WHEN bool_and(TRY_CAST(sig AS DOUBLE) IS NOT NULL) AND bool_and(sig IN ('0', '1')) THEN 'binary_numeric_text'
    WHEN bool_and(TRY_CAST(sig AS DOUBLE) IS NOT NULL) AND count(DISTINCT sig) <= 10 THEN 'numeric_text_low_cardinality'
    WHEN bool_and(TRY_CAST(sig AS DOUBLE) IS NOT NULL) THEN 'numeric_text_continuous' ELSE 'categorical_text' END AS rep
FROM (SELECT *, dtype = 'str' AND regexp_matches(lower(sig), '^\d+-(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)$') AS any_date,
   CASE WHEN sig IS NOT NULL THEN regexp_matches(sig, '^(<|>|>=|<=|≥|≤)\s*[-+]?\d') OR regexp_matches(sig, '^[-+]?\d+(\.\d+)?\s*-\s*[-+]?\d+(\.\d+)?$') END AS iv FROM {cells}) WHERE true GROUP BY feature"""


def _sample_sql(cells: str) -> str:
    return f"""SELECT feature, string_agg(sig, '|' ORDER BY sig) AS vals FROM
 (SELECT feature, sig, row_number() OVER (PARTITION BY feature ORDER BY sig) AS r FROM (SELECT DISTINCT feature, sig FROM {cells} WHERE sig IS NOT NULL)) WHERE r <= 12 GROUP BY 1"""


def value_audit(spark, folder):
    a, b = sources(spark, folder)
    found = audit.value_audit(
        audit.tokens(audit.long_cells(a, FEATURES)), audit.tokens(audit.long_cells(b, FEATURES)), GROUPS
    )
    lists = ("unique_values_sample_a", "unique_values_sample_b", "manual_review_reasons")
    return final(found.withColumns({c: F.array_join(c, "|") for c in lists}))


_BIN = "('binary_numeric', 'binary_numeric_text', 'binary_text_yes_no', 'binary_text_present_absent', 'binary_text_normal_abnormal', 'binary_text_good_poor')"
_NUM = "('numeric_continuous', 'numeric_text_continuous', 'numeric_low_cardinality', 'numeric_text_low_cardinality', 'interval_text_bins')"

VALUE_AUDIT_SQL = f"""
WITH ca AS ({_cells_sql(A_COLUMNS)}), cb AS ({_cells_sql(B_COLUMNS)}),
ta AS ({_coarse_sql("ca")}), tb AS ({_coarse_sql("cb")}), sa AS ({_sample_sql("ca")}), sb AS ({_sample_sql("cb")}),
j AS (SELECT ta.feature, ta.dtype AS dtype_a, tb.dtype AS dtype_b, ta.nn AS non_null_count_a, tb.nn AS non_null_count_b, ta.miss AS missing_count_a, tb.miss AS missing_count_b,
  ta.uniq AS unique_count_a, tb.uniq AS unique_count_b, ta.rep AS representation_a, tb.rep AS representation_b, sa.vals AS unique_values_sample_a, sb.vals AS unique_values_sample_b,
  ta.dates AS da, tb.dates AS db,
  CASE WHEN ta.rep = tb.rep AND ta.rep IN ('numeric_continuous', 'numeric_text_continuous', 'numeric_low_cardinality', 'interval_text_bins') THEN 'same_family_but_value_audit_needed'
    WHEN ta.rep = tb.rep THEN 'same_representation_family' WHEN ta.rep IN {_BIN} AND tb.rep IN {_BIN} THEN 'binary_encoding_mismatch'
    WHEN ta.rep IN {_NUM} AND tb.rep IN {_NUM} THEN 'numeric_vs_binned_or_text_numeric' ELSE 'representation_mismatch' END AS consistency_status
  FROM ta JOIN tb USING (feature) JOIN sa USING (feature) JOIN sb USING (feature)),
k AS (SELECT *, CASE consistency_status WHEN 'same_family_but_value_audit_needed' THEN 'review_value_ranges' WHEN 'same_representation_family' THEN 'review_category_values' ELSE 'manual_review_required' END AS recommended_action,
  concat_ws('|', CASE WHEN da THEN 'dataset_a:contains_excel_style_month_tokens' END, CASE WHEN db THEN 'dataset_b:contains_excel_style_month_tokens' END,
    CASE WHEN consistency_status IN ('binary_encoding_mismatch', 'numeric_vs_binned_or_text_numeric', 'representation_mismatch') THEN 'cross_dataset_representation_mismatch:' || representation_a || '_vs_' || representation_b END,
    CASE WHEN feature IN ('size', 'level') AND representation_b = 'interval_text_bins' THEN 'dataset_b_appears_pre_binned_while_dataset_a_is_not' END) AS manual_review_reasons FROM j),
m AS (SELECT *, CASE WHEN recommended_action = 'manual_review_required' THEN 'manual_review_required'
  WHEN representation_a IN ('numeric_continuous', 'numeric_text_continuous') OR representation_b IN ('numeric_continuous', 'numeric_text_continuous') THEN 'numeric_continuous'
  WHEN representation_a LIKE 'numeric%low_cardinality' OR representation_b LIKE 'numeric%low_cardinality' THEN 'numeric_or_ordinal_review'
  WHEN representation_a LIKE 'binary%' AND representation_b LIKE 'binary%' THEN 'binary' ELSE 'categorical' END AS recommended_modeling_type FROM k)
SELECT * EXCLUDE (da, db), CASE recommended_modeling_type {" ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in TYPE_NOTES.items())} END AS type_plan_notes,
  CASE WHEN manual_review_reasons <> '' THEN 'yes' ELSE 'no' END AS manual_review_required FROM m"""


def _strict_audit(spark, folder) -> DataFrame:
    a, b = sources(spark, folder)
    return audit.representation_audit(
        audit.tokens(audit.long_cells(a, FEATURES, "p_partkey"), row_key=True),
        audit.tokens(audit.long_cells(b, FEATURES, "p_partkey"), row_key=True),
        GROUPS,
    )


def representation_audit(spark, folder):
    lists = ("unique_examples_a", "unique_examples_b", "excel_like_tokens_b", "interval_examples_b")
    return final(_strict_audit(spark, folder).withColumns({c: F.array_join(c, "|") for c in lists}))


_TOKEN = r"regexp_replace(replace(replace(trim(raw), '≤', '<='), '≥', '>='), '\s+', ' ', 'g')"
_IV = r"(regexp_matches(token, '^(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)$') OR regexp_matches(token, '^<\s*(-?\d+(?:\.\d+)?)$') OR regexp_matches(token, '^>=\s*(-?\d+(?:\.\d+)?)$'))"
_DATE = r"regexp_matches(token, '^\d{1,2}-[A-Za-z]{3}$')"


def _norm_sql(cells: str) -> str:
    return f"SELECT feature, dtype, token, min(row) AS first_row, min(sig) AS sig, sum(n) AS n FROM (SELECT feature, dtype, {_TOKEN} AS token, min(row) AS row, min(sig) AS sig, count(*) AS n FROM {cells} WHERE raw IS NOT NULL GROUP BY 1, 2, raw) GROUP BY 1, 2, 3"


def _strict_sql(norm: str) -> str:
    words = " OR ".join(f"bool_and(lower(token) IN {v})" for v in VOCAB.values())
    return f"""SELECT feature, any_value(dtype) AS dtype, CASE
  WHEN any_value(dtype) <> 'str' AND bool_and(sig IN ('0', '1')) THEN 'binary_numeric' WHEN any_value(dtype) <> 'str' AND count(*) <= 10 THEN 'ordinal_numeric' WHEN any_value(dtype) <> 'str' THEN 'continuous_numeric'
  WHEN bool_or({_DATE}) THEN 'excel_like_corrupted_token' WHEN bool_and({_IV}) THEN 'interval_text' WHEN {words} THEN 'binary_text'
  WHEN bool_and(TRY_CAST(token AS DOUBLE) IS NOT NULL) AND bool_and(token IN ('0', '1')) THEN 'binary_numeric' WHEN bool_and(TRY_CAST(token AS DOUBLE) IS NOT NULL) AND count(*) <= 10 THEN 'ordinal_numeric'
  WHEN bool_and(TRY_CAST(token AS DOUBLE) IS NOT NULL) THEN 'continuous_numeric' ELSE 'categorical_text' END AS rep FROM {norm} GROUP BY 1"""


def _examples_sql(norm: str, condition: str = "true", limit: int | None = 10) -> str:
    cut = f"WHERE r <= {limit}" if limit else ""
    return f"SELECT feature, string_agg(token, '|' ORDER BY first_row) AS v FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY first_row) AS r FROM {norm} WHERE {condition}) {cut} GROUP BY 1"


STRICT = f"""ca AS ({_cells_sql(A_COLUMNS)}), cb AS ({_cells_sql(B_COLUMNS)}), na AS ({_norm_sql("ca")}), nb AS ({_norm_sql("cb")}),
ra AS ({_strict_sql("na")}), rb AS ({_strict_sql("nb")}),
sa AS (SELECT ra.feature AS feature_name, CASE WHEN ra.feature IN ('flag', 'state') THEN 'binary_or_categorical_mismatch' WHEN ra.feature = 'level' THEN 'ordinal_or_stage_like'
    WHEN ra.feature IN ('amount', 'size') THEN 'interval_or_numeric_mismatch' ELSE 'other' END AS priority_group,
  ra.dtype AS dtype_style_a, rb.dtype AS dtype_style_b, ra.rep AS representation_type_a, rb.rep AS representation_type_b,
  ea.v AS unique_examples_a, eb.v AS unique_examples_b, coalesce(ed.v, '') AS excel_like_tokens_b, coalesce(ei.v, '') AS interval_examples_b
  FROM ra JOIN rb USING (feature) JOIN ({_examples_sql("na")}) ea USING (feature) JOIN ({_examples_sql("nb")}) eb USING (feature)
  LEFT JOIN ({_examples_sql("nb", _DATE, None)}) ed USING (feature) LEFT JOIN ({_examples_sql("nb", _IV)}) ei USING (feature)),
strict AS (SELECT *, concat_ws('; ', CASE WHEN excel_like_tokens_b <> '' THEN 'excel_like_tokens_detected' END, CASE WHEN interval_examples_b <> '' THEN 'interval_style_values_detected' END,
  CASE WHEN feature_name IN ('size', 'level') THEN 'high_priority_excel_investigation' END, CASE WHEN feature_name IN ('amount', 'size') THEN 'high_priority_interval_investigation' END) AS notes FROM sa)"""

REPRESENTATION_SQL = f"WITH {STRICT} SELECT * FROM strict"


def audit_summary(spark, folder):
    return final(audit.audit_summary(_strict_audit(spark, folder)))


SUMMARY_SQL = f"""
WITH {STRICT}
SELECT 'representation_type' AS item, representation_type_b AS detail, count(*) AS value FROM strict GROUP BY 2
UNION ALL SELECT 'priority_group', priority_group, count(*) FROM strict GROUP BY 2
UNION ALL SELECT 'excel_like_corruption', feature_name, 1 FROM strict WHERE representation_type_b = 'excel_like_corrupted_token'"""


def rules(spark, folder):
    return final(audit.propose_rules(_strict_audit(spark, folder), GROUPS))


_NOTE = {k: text(v.format(a="a", b="b")) for k, v in RULE_NOTES.items()}
RULES = f"""{STRICT},
rk AS (SELECT feature_name, representation_type_a, representation_type_b, CASE
  WHEN feature_name = 'flag' AND representation_type_a = 'binary_text' AND representation_type_b = 'binary_numeric' THEN 1
  WHEN feature_name = 'state' AND representation_type_a = 'binary_text' AND representation_type_b = 'binary_numeric' THEN 2
  WHEN feature_name = 'size' AND representation_type_b = 'excel_like_corrupted_token' THEN 3 WHEN feature_name = 'level' AND representation_type_b = 'excel_like_corrupted_token' THEN 4
  WHEN feature_name IN ('amount', 'size') AND representation_type_b = 'interval_text' THEN 5 ELSE 6 END AS k FROM strict),
rules AS (SELECT * EXCLUDE (k), CASE WHEN k <= 2 THEN 'keep_as_binary_and_map' WHEN k = 3 THEN 'repair_excel_like_token_then_convert_to_ordered_bin_code' WHEN k = 5 THEN 'convert_interval_to_ordered_bin_code' ELSE 'unresolved' END AS proposed_action,
  CASE WHEN k <= 3 THEN 'medium' WHEN k = 5 THEN 'high' ELSE 'low' END AS confidence_level, CASE WHEN k = 5 THEN 'no' ELSE 'yes' END AS manual_review_required,
  CASE WHEN k <= 2 THEN 'conditional_after_mapping_confirmation' WHEN k = 5 THEN 'repaired_candidate_only_not_cross_dataset_safe' ELSE 'not_safe_for_cross_dataset_validation' END AS cross_dataset_validation_status,
  concat_ws(' ', CASE k WHEN 1 THEN {_NOTE['low_risk_binary']} WHEN 2 THEN {_NOTE['mapped_binary']} WHEN 3 THEN {_NOTE['repairable_spreadsheet']} WHEN 4 THEN {_NOTE['stage_like']} WHEN 5 THEN {_NOTE['interval']} END,
    CASE WHEN feature_name IN ('size', 'level') THEN {_NOTE['spreadsheet_suffix']} END, CASE WHEN feature_name IN ('amount', 'size') AND k <> 5 THEN {_NOTE['interval_suffix']} END) AS notes FROM rk)"""
RULES_SQL = f"WITH {RULES} SELECT * FROM rules"


def unresolved_rules(spark, folder):
    return final(audit.unresolved_report(audit.propose_rules(_strict_audit(spark, folder), GROUPS)))


UNRESOLVED_SQL = f"""WITH {RULES} SELECT * EXCLUDE (notes), notes AS reason FROM rules
WHERE NOT (proposed_action = 'convert_interval_to_ordered_bin_code' AND confidence_level = 'high' AND manual_review_required = 'no')"""


def _codes(spark, folder) -> DataFrame:
    _, b = sources(spark, folder)
    return audit.bin_codes(audit.tokens(audit.long_cells(b, ["amount", "level", "size"])))


def bin_codes(spark, folder):
    return final(_codes(spark, folder).filter("code is not null").select("feature", "token", "row_count", "canonical", "code"))


CODES = rf"""{STRICT},
iv AS (SELECT feature, token, n, regexp_extract(token, '^(-?\d+)\s*-', 1) AS lo, regexp_extract(token, '(\d+)$', 1) AS hi FROM nb WHERE feature IN ('amount', 'level', 'size') AND {_IV}),
codes AS (SELECT feature, token, n::BIGINT AS row_count, token AS canonical,
  dense_rank() OVER (PARTITION BY feature ORDER BY CASE WHEN token LIKE '<%' THEN '-Infinity'::DOUBLE WHEN token LIKE '>%' THEN hi::DOUBLE ELSE lo::DOUBLE END,
                     CASE WHEN token LIKE '>%' THEN 'Infinity'::DOUBLE ELSE hi::DOUBLE END) - 1 AS code FROM iv)"""
BIN_CODES_SQL = f"WITH {CODES} SELECT feature, token, row_count, canonical, code FROM codes"


def repaired(spark, folder):
    _, b = sources(spark, folder)
    codes = _codes(spark, folder)
    chosen = [r["feature_name"] for r in audit.safe_rules(audit.propose_rules(_strict_audit(spark, folder), GROUPS)).collect()]
    return final(audit.apply_repairs(b, "p_partkey", chosen, codes).select("p_partkey", "amount", "size", "level"))


REPAIRED_SQL = f"""WITH {CODES}
SELECT p_partkey, codes.code AS amount, ({B_COLUMNS['size'][1]}) AS size, ({B_COLUMNS['level'][1]}) AS level FROM part
JOIN codes ON codes.feature = 'amount' AND codes.token = replace({B_COLUMNS['amount'][1]}, '≥', '>=')"""


def harmonised(spark, folder):
    """The whole run over two sources with column names and labels of their own, and a reviewed mapping; the repaired side."""
    a, b = sources(spark, folder)
    source = {}
    for side, df, words in (("a", a, ("well", "ill")), ("b", b, ("no", "yes"))):
        renamed = df.select("p_partkey", *[F.col(f).alias(f"{side} {f}") for f in FEATURES], F.when(F.col("target") == 1, words[1]).otherwise(words[0]).alias("class"))
        source[side] = renamed
    reviewed = [(f"a {f}", f"b {f}", f, "yes", "yes", "yes", "", "no") for f in FEATURES]
    mapping = spark.createDataFrame(reviewed, ", ".join(f"{c} string" for c in align.MAPPING_COLUMNS))
    out = harmonise(source["a"], source["b"], mapping, "p_partkey", "class", {"well": 0, "ill": 1}, {"no": 0, "yes": 1}, GROUPS)
    return final(out.repaired_b.select("p_partkey", "amount", "size", "level", "target"))


HARMONISED_SQL_TAIL = "(p_partkey % 3 = 0)::BIGINT AS target"


def repaired_by_join(spark, folder):
    """How many cells got which code."""
    _, b = sources(spark, folder)
    out = audit.apply_repairs(b, "p_partkey", ["amount"], _codes(spark, folder))
    return final(out.groupBy("amount").agg(F.count(F.lit(1)).alias("row_count")))


HARMONISED_SQL = REPAIRED_SQL.replace(" AS level FROM part", f" AS level, {HARMONISED_SQL_TAIL} FROM part")
REPAIRED_JOIN_SQL = f"WITH {CODES} SELECT code AS amount, row_count FROM codes WHERE feature = 'amount'"


def repair_report(spark, folder):
    found = audit.propose_rules(_strict_audit(spark, folder), GROUPS)
    return final(audit.repair_report(found, _codes(spark, folder)))


REPORT_SQL = f"""WITH {CODES}, {RULES[len(STRICT) + 1:]}
SELECT feature_name, 'yes' AS repair_applied, 'ordered_bin_code' AS repair_type, token AS original_value, code::VARCHAR AS repaired_value, cross_dataset_validation_status, notes
FROM rules JOIN codes ON codes.feature = feature_name WHERE proposed_action = 'convert_interval_to_ordered_bin_code'
UNION ALL SELECT feature_name, 'no', 'none', '', '', cross_dataset_validation_status, notes FROM rules WHERE proposed_action <> 'convert_interval_to_ordered_bin_code'"""


def direction_audit(spark, folder):
    a, b = sources(spark, folder)
    found = audit.direction_audit(a, b, ["flag", "state"], "target", "p_partkey", GROUPS)
    flat = {c: F.array_join(c, "|") for c in ("unique_values_a", "unique_values_b")}

    def shown(pair):
        return F.concat_ws("=", pair["key"], pair["value"].cast("string"))

    for s in "ab":
        flat[f"value_counts_{s}"] = F.array_join(F.transform(F.map_entries(f"value_counts_{s}"), shown), ",")
    return final(found.withColumns(flat).drop("target_breakdown_a", "target_breakdown_b"))


def _counts_sql(cells: str) -> str:
    return f"SELECT feature, string_agg(v || '=' || n, ',' ORDER BY v) AS counts FROM (SELECT feature, coalesce(sig, '<NA>') AS v, count(*) AS n FROM {cells} WHERE feature IN ('flag', 'state') GROUP BY 1, 2) GROUP BY 1"


DIRECTION_SQL = f"""WITH {STRICT}, va AS ({_counts_sql("ca")}), vb AS ({_counts_sql("cb")})
SELECT feature_name, representation_type_a, representation_type_b, dtype_style_a AS dtype_a, dtype_style_b AS dtype_b, unique_examples_a AS unique_values_a, unique_examples_b AS unique_values_b,
  va.counts AS value_counts_a, vb.counts AS value_counts_b, 'yes' AS manual_review_required,
  CASE feature_name WHEN 'flag' THEN {text(DIRECTION_NOTES['low_risk_binary'].format(b='b'))} ELSE {text(DIRECTION_NOTES['mapped_binary'].format(b='b'))} END AS notes
FROM strict JOIN va ON va.feature = feature_name JOIN vb ON vb.feature = feature_name"""


def direction_counts(spark, folder):
    a, _ = sources(spark, folder)
    return final(audit.direction_counts(a, ["flag", "state", "level"], "target"))


DIRECTION_COUNTS_SQL = f"""WITH ca AS ({_cells_sql(A_COLUMNS)})
SELECT feature, target::BIGINT AS target, coalesce(sig, '<NA>') AS value, count(*) AS row_count FROM ca WHERE feature IN ('flag', 'state', 'level') GROUP BY 1, 2, 3"""

def direction_full(spark, folder):
    """Counts by value and class of both sides, also of features with many values."""
    a, b = sources(spark, folder)
    return final(audit.direction_long(a, b, ["flag", "state", "level", "amount", "size"], "target"))


DIRECTION_FULL_SQL = f"""WITH ca AS ({_cells_sql(A_COLUMNS)}), cb AS ({_cells_sql(B_COLUMNS)}),
both_sides AS (SELECT 'a' AS side, * FROM ca UNION ALL SELECT 'b', * FROM cb)
SELECT side, feature, target::BIGINT AS target, CASE WHEN raw IS NULL THEN '<NA>' WHEN dtype <> 'str' AND regexp_matches(sig, '^-?\\d+$') THEN sig ELSE trim(raw) END AS value, count(*) AS row_count
FROM both_sides WHERE feature IN ('flag', 'state', 'level', 'amount', 'size') GROUP BY 1, 2, 3, 4"""

QUERIES = {
    "audit_direction_full": direction_full,
    "align_candidates": candidates,
    "align_dropped_columns": dropped,
    "align_mapping_violations": mapping_violations,
    "align_projection": aligned,
    "tokens_parsed": tokens,
    "audit_values": value_audit,
    "audit_representation": representation_audit,
    "audit_summary": audit_summary,
    "rules_proposed": rules,
    "rules_unresolved": unresolved_rules,
    "repair_bin_codes": bin_codes,
    "repair_applied": repaired,
    "harmonise_whole": harmonised,
    "repair_applied_by_join": repaired_by_join,
    "repair_report": repair_report,
    "audit_binary_direction": direction_audit,
    "audit_direction_counts": direction_counts,
}
ORACLE = {
    "audit_direction_full": DIRECTION_FULL_SQL,
    "align_candidates": CANDIDATES_SQL,
    "align_dropped_columns": DROPPED_SQL,
    "align_mapping_violations": MAPPING_SQL,
    "align_projection": ALIGNED_SQL,
    "tokens_parsed": TOKENS_SQL,
    "audit_values": VALUE_AUDIT_SQL,
    "audit_representation": REPRESENTATION_SQL,
    "audit_summary": SUMMARY_SQL,
    "rules_proposed": RULES_SQL,
    "rules_unresolved": UNRESOLVED_SQL,
    "repair_bin_codes": BIN_CODES_SQL,
    "repair_applied": REPAIRED_SQL,
    "harmonise_whole": HARMONISED_SQL,
    "repair_applied_by_join": REPAIRED_JOIN_SQL,
    "repair_report": REPORT_SQL,
    "audit_binary_direction": DIRECTION_SQL,
    "audit_direction_counts": DIRECTION_COUNTS_SQL,
}
