"""Splits, metrics, curves, intervals and tests on predictions derived from the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.fixed import DEFAULT_CONTEXT, LEAKAGE_NOTES, METRICS, REPLICATES
from riskloom.functions.hashing import uniform
from riskloom.operators import inference, leakage, metrics, ranking, split
from riskloom.operators.bootstrap import bootstrap_metrics
from riskloom.operators.contracts import prediction_misalignment
from riskloom.operators.monitor import exact_quantiles
from riskloom.queries.common import final, sql_hash, sql_hash_long, table, text
from riskloom.sources.tables import union_tables

MODELS = ("coin", "price", "blend")
SCORE_SEED = 7


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("target", (F.col("o_orderstatus") == "F").cast("int"))


ORDERS = "SELECT *, (o_orderstatus = 'F')::INT AS target FROM orders"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Three deterministic scores per order, as a long prediction table."""
    u = uniform(SCORE_SEED, F.col("o_orderkey"))
    scores = {
        "coin": F.round(u, 4),
        "price": F.round(F.col("o_totalprice") / 500000.0, 3),
        "blend": F.round(0.8 * u + 0.2 * F.col("target"), 4),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("model_name"), s.alias("risk_score")) for m, s in scores.items()])
    return (
        orders(spark, folder)
        .select(F.col("o_orderkey").alias("row_index"), F.col("target").alias("target_true"), F.inline(rows))
        .withColumn("prediction_label", (F.col("risk_score") >= 0.5).cast("int"))
    )


PREDICTIONS = f"""
base AS (SELECT o_orderkey AS row_index, (o_orderstatus = 'F')::INT AS target_true, o_totalprice,
                {sql_hash("'7'", "o_orderkey")} / 4294967296.0::DOUBLE AS u FROM orders),
scored AS (SELECT row_index, target_true, 'coin' AS model_name, round(u, 4) AS risk_score FROM base
  UNION ALL SELECT row_index, target_true, 'price', round(o_totalprice / 500000.0::DOUBLE, 3) FROM base
  UNION ALL SELECT row_index, target_true, 'blend', round(0.8::DOUBLE * u + 0.2::DOUBLE * target_true, 4) FROM base),
pred AS (SELECT *, (risk_score >= 0.5::DOUBLE)::INT AS prediction_label FROM scored)"""


def metric_sql(source: str, groups: str, rounded: bool = True) -> str:
    """CTE body with the eight metrics per group of a prediction table, by plain window functions."""
    r = (lambda e: f"round({e}, 6)") if rounded else (lambda e: e)
    return f"""
SELECT {groups}, (p + n)::BIGINT AS n_rows, p::BIGINT AS n_positive, n::BIGINT AS n_negative,
  {r("CASE WHEN p > 0 AND n > 0 THEN wins / (p::DOUBLE * n) END")} AS auroc, {r("ap")} AS auprc,
  {r("(tp + n - fp) / (p + n)")} AS accuracy,
  {r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END")} AS precision,
  {r("CASE WHEN p > 0 THEN tp / p ELSE 0.0::DOUBLE END")} AS recall_sensitivity,
  {r("CASE WHEN n > 0 THEN (n - fp) / n END")} AS specificity,
  {r("CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0.0::DOUBLE END")} AS f1_score,
  {r("squares / (p + n)")} AS brier_score
FROM (SELECT {groups}, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp,
        sum(pos * (below_neg + neg / 2.0::DOUBLE)) AS wins,
        sum(pos / all_pos * (from_pos / from_all)) AS ap,
        sum(pos * (risk_score - 1) * (risk_score - 1) + neg * risk_score * risk_score) AS squares
      FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {groups} ORDER BY risk_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below_neg,
              sum(pos) OVER (PARTITION BY {groups})::DOUBLE AS all_pos,
              sum(pos) OVER (PARTITION BY {groups} ORDER BY risk_score DESC)::DOUBLE AS from_pos,
              sum(pos + neg) OVER (PARTITION BY {groups} ORDER BY risk_score DESC)::DOUBLE AS from_all
            FROM (SELECT {groups}, risk_score, sum(target_true)::DOUBLE AS pos, sum(1 - target_true)::DOUBLE AS neg,
                    sum(target_true * prediction_label)::DOUBLE AS tp, sum((1 - target_true) * prediction_label)::DOUBLE AS fp
                  FROM {source} GROUP BY {groups}, risk_score))
      GROUP BY {groups})"""


METRICS_SQL = f"WITH {PREDICTIONS} {metric_sql('pred', 'model_name')}"


def metric_table(spark, folder):
    return final(metrics.metric_table(predictions(spark, folder), ["model_name"]))


def metrics_null_model(spark, folder):
    """A model without a name is a model like any other."""
    unnamed = predictions(spark, folder).withColumn("model_name", F.when(F.col("model_name") != "coin", F.col("model_name")))
    return final(metrics.metric_table(unnamed, ["model_name"]))


METRICS_NULL_SQL = f"""WITH {PREDICTIONS}, unnamed AS (SELECT * REPLACE (nullif(model_name, 'coin') AS model_name) FROM pred)
{metric_sql('unnamed', 'model_name')}"""


# --- Splits ---------------------------------------------------------------------


def split_sql(source: str, key: str, target: str, seed: int = 42) -> str:
    """Rank rows by digest in each class; class sizes get the largest remainders."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY md5('{seed}|' || {key}), {key}) AS place FROM {source}),
sizes AS (SELECT {target} AS s, count(*) AS n, floor(0.2::DOUBLE * count(*)) AS lower FROM {source} GROUP BY 1),
quota AS (SELECT s, lower + (row_number() OVER (ORDER BY lower - 0.2::DOUBLE * n, s::VARCHAR)
            <= (SELECT ceil(0.2::DOUBLE * sum(n)) - sum(lower) FROM sizes))::INT AS take FROM sizes),
parts AS (SELECT ranked.*, CASE WHEN place <= take THEN 'test' ELSE 'train' END AS split
          FROM ranked JOIN quota ON ranked.{target} = quota.s)"""


ORDER_SPLIT = f"o AS ({ORDERS}), {split_sql('o', 'o_orderkey', 'target')}"


def split_orders(spark, folder) -> DataFrame:
    return split.stratified_split(orders(spark, folder), "o_orderkey", "target")


def split_rows(spark, folder):
    return final(split.split_table(split_orders(spark, folder), "o_orderkey", "target"))


SPLIT_SQL = f"WITH {ORDER_SPLIT} SELECT o_orderkey AS row_index, split, target::BIGINT AS target FROM parts"


def split_many_strata(spark, folder):
    """A stratum for every customer, and one for the orders of every seventh, which have none."""
    stratum = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))
    rows = table(spark, folder, "orders").select("o_orderkey", stratum.alias("stratum"))
    return final(split.stratified_split(rows, "o_orderkey", "stratum"))


MANY_STRATA_SQL = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS stratum FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || o_orderkey), o_orderkey) AS place FROM o),
sizes AS (SELECT stratum AS s, count(*) AS n, floor(0.2::DOUBLE * count(*)) AS lower FROM o GROUP BY 1),
quota AS (SELECT s, lower + (row_number() OVER (ORDER BY lower - 0.2::DOUBLE * n, coalesce(s::VARCHAR, ''))
            <= (SELECT ceil(0.2::DOUBLE * sum(n)) - sum(lower) FROM sizes))::INT AS take FROM sizes)
SELECT o_orderkey, stratum, CASE WHEN place <= take THEN 'test' ELSE 'train' END AS split FROM ranked JOIN quota ON stratum IS NOT DISTINCT FROM s"""


def folds(spark, folder):
    fold = split.stratified_folds(orders(spark, folder), "o_orderkey", "o_orderpriority")
    return final(fold.select("o_orderkey", "o_orderpriority", "fold"))


FOLDS_SQL = """
WITH r AS (SELECT o_orderkey, o_orderpriority,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS place,
             count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority,
  ((place > ceil(n / 5.0))::INT + (place > ceil(2 * n / 5.0))::INT + (place > ceil(3 * n / 5.0))::INT + (place > ceil(4 * n / 5.0))::INT)::BIGINT AS fold
FROM r"""


def split_check(spark, folder):
    source = orders(spark, folder)
    parts = split.split_table(split_orders(spark, folder), "o_orderkey", "target")
    return final(split.split_check(source, "o_orderkey", parts))


SPLIT_CHECK_SQL = f"""
WITH {ORDER_SPLIT}
SELECT split, target::BIGINT AS target, count(*) AS row_count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS ratio, true AS split_matches_rows
FROM parts GROUP BY 1, 2"""


def split_selection(spark, folder):
    source = orders(spark, folder)
    parts = split.split_table(split_orders(spark, folder), "o_orderkey", "target")
    chosen = split.take_split(source, "o_orderkey", parts, "test")
    return final(
        chosen.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("row_count"), F.sum("o_totalprice").alias("total_price")),
        2,
    )


SPLIT_SELECTION_SQL = f"""
WITH {ORDER_SPLIT} SELECT o_orderpriority, count(*) AS row_count, round(sum(o_totalprice), 2) AS total_price
FROM parts WHERE split = 'test' GROUP BY 1"""


def document_split(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return split.stratified_split(docs, "doc_id", "quality")


DOCUMENT_SPLIT = (
    "d AS (SELECT d.*, quality, toxic FROM documents d JOIN labels l USING (doc_id)), "
    + split_sql("d", "doc_id", "quality")
)


def split_leakage(spark, folder):
    return final(split.split_leakage(document_split(spark, folder), "doc_id", ["text", "lang"]))


SPLIT_LEAKAGE_SQL = f"""
WITH {DOCUMENT_SPLIT}
SELECT count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'test') AS test_count,
  (SELECT count(*) FROM (SELECT doc_id FROM parts GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS index_overlap_count,
  (SELECT count(*) FROM (SELECT text, lang FROM parts GROUP BY 1, 2 HAVING count(DISTINCT split) > 1)) AS exact_feature_row_overlap_count
FROM parts"""


def overlap_examples(spark, folder):
    """Two seeds disagree on many rows; their union has ids in both parts."""
    source = orders(spark, folder)
    both = split.stratified_split(source, "o_orderkey", "target", seed=1).unionByName(
        split.stratified_split(source, "o_orderkey", "target", seed=2)
    )
    return final(split.overlap_examples(both, "o_orderkey"))


OVERLAP_SQL = f"""
WITH o AS ({ORDERS}),
a AS (WITH {split_sql('o', 'o_orderkey', 'target', 1)} SELECT o_orderkey, split FROM parts),
b AS (WITH {split_sql('o', 'o_orderkey', 'target', 2)} SELECT o_orderkey, split FROM parts)
SELECT o_orderkey FROM a JOIN b USING (o_orderkey) WHERE a.split <> b.split ORDER BY 1 LIMIT 10"""


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: exact split, deterministic score, eight metrics per part."""
    scored = document_split(spark, folder).select(
        "split",
        F.col("quality").alias("target_true"),
        F.round(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)) * 0.5 + 0.5 * uniform(SCORE_SEED, F.col("doc_id")), 4).alias("risk_score"),
    )
    scored = scored.withColumn("prediction_label", (F.col("risk_score") >= 0.5).cast("int"))
    return final(metrics.metric_table(scored, ["split"]))


FLAGSHIP_SQL = f"""
WITH {DOCUMENT_SPLIT},
scored AS (SELECT split, quality AS target_true,
  round(least(n_chars / 4000.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE + 0.5::DOUBLE * ({sql_hash("'7'", "doc_id")} / 4294967296.0::DOUBLE), 4) AS risk_score FROM parts),
pred AS (SELECT *, (risk_score >= 0.5::DOUBLE)::INT AS prediction_label FROM scored)
{metric_sql('pred', 'split')}"""

# --- Metrics and curves ---------------------------------------------------------


def confusion(spark, folder):
    return final(metrics.confusion(predictions(spark, folder), ["model_name"]))


CONFUSION_SQL = f"""
WITH {PREDICTIONS}
SELECT model_name, t.v::BIGINT AS target_true, l.v::BIGINT AS prediction_label,
       count(*) FILTER (target_true = t.v AND prediction_label = l.v) AS row_count
FROM pred, (VALUES (0), (1)) t(v), (VALUES (0), (1)) l(v) GROUP BY 1, 2, 3"""


def lineitem_auroc(spark, folder):
    """AUROC over all line items: does the price tell returned items?"""
    items = table(spark, folder, "lineitem").select(
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("target_true"),
        F.col("l_extendedprice").alias("risk_score"),
    )
    return final(metrics.auroc(items, ["l_linestatus"]))


LINEITEM_AUROC_SQL = """
WITH c AS (SELECT l_linestatus, l_extendedprice AS s, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg
           FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY l_linestatus ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM c)
SELECT l_linestatus, sum(pos)::BIGINT AS n_positive, sum(neg)::BIGINT AS n_negative, count(*) AS distinct_scores,
       round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auroc
FROM w GROUP BY 1"""


def roc_curve(spark, folder):
    return final(metrics.roc_points(predictions(spark, folder), ["model_name"]))


CURVE = """
cells AS (SELECT model_name, risk_score, sum(target_true) AS pos, sum(1 - target_true) AS neg FROM pred GROUP BY 1, 2),
curve AS (SELECT model_name, risk_score, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp,
            sum(pos) OVER (PARTITION BY model_name) AS p, sum(neg) OVER (PARTITION BY model_name) AS n
          FROM cells WINDOW d AS (PARTITION BY model_name ORDER BY risk_score DESC))"""

ROC_SQL = f"""
WITH {PREDICTIONS}, {CURVE}
SELECT model_name, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, risk_score AS threshold FROM curve
UNION ALL SELECT DISTINCT model_name, 0.0::DOUBLE, 0.0::DOUBLE, 'Infinity'::DOUBLE FROM pred"""


def pr_curve(spark, folder):
    return final(metrics.pr_points(predictions(spark, folder), ["model_name"]))


PR_SQL = f"""
WITH {PREDICTIONS}, {CURVE}
SELECT model_name, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, risk_score AS threshold FROM curve
UNION ALL SELECT DISTINCT model_name, 1.0::DOUBLE, 0.0::DOUBLE, NULL FROM pred"""


def calibration(spark, folder):
    return final(metrics.calibration(predictions(spark, folder), ["model_name"]))


CALIBRATION_SQL = f"""
WITH {PREDICTIONS}
SELECT model_name, least(greatest(ceil(risk_score * 10) - 1, 0), 9)::BIGINT AS bin, count(*) AS row_count,
       round(avg(target_true), 6) AS positive_share, round(avg(risk_score), 6) AS mean_score
FROM pred GROUP BY 1, 2"""


def fold_metrics(spark, folder) -> DataFrame:
    fold = split.stratified_folds(orders(spark, folder), "o_orderkey", "target").select(
        F.col("o_orderkey").alias("row_index"), "fold"
    )
    return metrics.metric_table(predictions(spark, folder).join(fold, "row_index"), ["model_name", "fold"])


def fold_summary(spark, folder):
    return final(metrics.fold_summary(fold_metrics(spark, folder), ["model_name"]))


FOLD_METRICS = f"""{PREDICTIONS},
ranked AS (SELECT o_orderkey AS row_index, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY md5('42|' || o_orderkey), o_orderkey) AS place,
             count(*) OVER (PARTITION BY o_orderstatus = 'F') AS n FROM orders),
fold AS (SELECT row_index, (place > ceil(n / 5.0))::INT + (place > ceil(2 * n / 5.0))::INT + (place > ceil(3 * n / 5.0))::INT + (place > ceil(4 * n / 5.0))::INT AS fold FROM ranked),
folded AS (SELECT pred.*, fold FROM pred JOIN fold USING (row_index)),
fm AS ({metric_sql("folded", "model_name, fold", rounded=False)})"""

FOLD_SUMMARY_SQL = f"""
WITH {FOLD_METRICS}
SELECT model_name, count(*) AS cv_fold_count, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in METRICS)}
FROM fm GROUP BY 1"""


def best_model(spark, folder):
    summary = metrics.fold_summary(fold_metrics(spark, folder), ["model_name"])
    order = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model_name"))
    best = metrics.best_by(summary.withColumn("model_order", order), [F.desc("auroc_mean"), F.asc("model_order")], ["model_name", "auroc_mean"])
    tested = metrics.metric_table(predictions(spark, folder), ["model_name"])
    return final(best.join(tested.select("model_name", "accuracy", "auprc"), "model_name"))


BEST_MODEL_SQL = f"""
WITH {FOLD_METRICS},
best AS (SELECT model_name, round(avg(auroc), 6) AS auroc_mean FROM fm GROUP BY 1
         ORDER BY avg(auroc) DESC, list_position(['coin', 'price', 'blend'], model_name) LIMIT 1),
tested AS ({metric_sql("pred", "model_name")})
SELECT model_name, auroc_mean, accuracy, auprc FROM best JOIN tested USING (model_name)"""


def fallback_best(spark, folder):
    table_ = metrics.metric_table(predictions(spark, folder), ["model_name"])
    order = [F.desc("auroc"), F.desc("auprc"), F.desc("accuracy"), F.asc("model_name")]
    return final(metrics.best_by(table_, order, ["model_name", "auroc", "auprc", "accuracy"]))


FALLBACK_SQL = f"""
WITH {PREDICTIONS}, m AS ({metric_sql("pred", "model_name")})
SELECT model_name, auroc, auprc, accuracy FROM m ORDER BY auroc DESC, auprc DESC, accuracy DESC, model_name LIMIT 1"""


def comparison(spark, folder):
    table_ = metrics.metric_table(predictions(spark, folder), ["model_name"])
    return final(metrics.compare_to_reference(table_, "model_name", "blend", ["auroc", "auprc", "accuracy"]))


COMPARISON_SQL = f"""
WITH {PREDICTIONS}, m AS ({metric_sql("pred", "model_name", rounded=False)})
SELECT a.model_name AS baseline_model, b.model_name AS compared_model,
  {", ".join(f"round(a.{x}, 6) AS baseline_{x}, round(b.{x}, 6) AS compared_{x}, round(b.{x} - a.{x}, 6) AS {x}_difference" for x in ("auroc", "auprc", "accuracy"))}
FROM m a, m b WHERE b.model_name = 'blend' AND a.model_name <> 'blend'"""


def long_table(spark, folder):
    return final(metrics.long_metrics(metrics.metric_table(predictions(spark, folder), ["model_name"]), ["model_name"]))


LONG_SQL = f"""
WITH {PREDICTIONS}, m AS ({metric_sql("pred", "model_name")})
""" + " UNION ALL ".join(f"SELECT model_name, '{x}' AS metric, {x} AS value FROM m" for x in METRICS)


def alignment(spark, folder):
    """Two models lack some rows and one sees another truth; those rows are reported."""
    p = predictions(spark, folder)
    key, model = F.col("row_index"), F.col("model_name")
    broken = union_tables(
        [
            p.filter((model == "coin") & (key % 500 != 3)),
            p.filter(model == "price").withColumn("target_true", F.when(key % 700 == 5, 1 - F.col("target_true")).otherwise(F.col("target_true"))),
            p.filter(model == "blend"),
        ]
    )
    return final(prediction_misalignment(broken, "row_index", "model_name", MODELS))


ALIGNMENT_SQL = f"""
WITH {PREDICTIONS},
b AS (SELECT row_index, model_name, target_true FROM pred WHERE model_name = 'coin' AND row_index % 500 <> 3
  UNION ALL SELECT row_index, model_name, CASE WHEN row_index % 700 = 5 THEN 1 - target_true ELSE target_true END FROM pred WHERE model_name = 'price'
  UNION ALL SELECT row_index, model_name, target_true FROM pred WHERE model_name = 'blend')
SELECT row_index, count(*) AS row_count, count(DISTINCT model_name) AS model_count,
       min(target_true)::BIGINT AS lowest_truth, max(target_true)::BIGINT AS highest_truth
FROM b GROUP BY 1 HAVING count(*) <> 3 OR count(DISTINCT model_name) <> 3 OR min(target_true) <> max(target_true)"""


def midranks(spark, folder):
    items = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity")
    return final(ranking.midranks(items, ["l_returnflag"], "l_quantity"))


MIDRANKS_SQL = """
SELECT l_returnflag, l_quantity, count(*) AS ties, round(min(r) + (count(*) - 1) / 2.0::DOUBLE, 6) AS midrank
FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1, 2"""


def quantiles(spark, folder):
    items = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    return final(exact_quantiles(items, ["l_returnflag"], "l_extendedprice", {"lower": 0.025, "middle": 0.5, "upper": 0.975}))


QUANTILES_SQL = """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS lower, round(quantile_cont(l_extendedprice, 0.5), 6) AS middle,
       round(quantile_cont(l_extendedprice, 0.975), 6) AS upper FROM lineitem GROUP BY 1"""

# --- Leakage screen -------------------------------------------------------------


def screen_table(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", "c_nationkey"
    )
    parts = split_orders(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "target", "split")
    joined = parts.join(customers, "o_custkey")
    key = F.col("o_orderkey")
    return joined.select(
        F.when(key % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "c_acctbal",
        (F.col("target") * 10 + F.col("o_totalprice") / 1000000).alias("leak"),
        F.lit(1.0).alias("fixed"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        "c_mktsegment",
        F.concat(F.lit("level"), F.col("target").cast("string")).alias("echo"),
        "target",
        "split",
    )


SCREEN_NUMERIC = ("o_totalprice", "c_acctbal", "leak", "fixed")
SCREEN_TEXT = ("o_orderpriority", "c_mktsegment", "echo")


def feature_screen(spark, folder):
    return final(leakage.feature_screen(screen_table(spark, folder), "target"))


SCREEN_BODY = f"""{ORDER_SPLIT},
s AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS o_totalprice, c_acctbal, target * 10 + o_totalprice / 1000000 AS leak,
        1.0::DOUBLE AS fixed, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority, c_mktsegment,
        'level' || target AS echo, target, split FROM parts JOIN customer ON o_custkey = c_custkey),
num AS ({" UNION ALL ".join(f"SELECT '{c}' AS f, split, target AS y, {c} AS x FROM s WHERE {c} IS NOT NULL" for c in SCREEN_NUMERIC)}),
ncell AS (SELECT f, split, x, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM num GROUP BY 1, 2, 3),
nrun AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY f, split ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ncell),
nsig AS (SELECT f, split, CASE WHEN count(*) > 1 THEN greatest(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 1 - sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))) END AS score,
           sum(pos + neg)::BIGINT AS observed, NULL::BIGINT AS levels FROM nrun GROUP BY 1, 2),
cat AS ({" UNION ALL ".join(f"SELECT '{c}' AS f, split, target AS y, {c} AS x FROM s" for c in SCREEN_TEXT)}),
clev AS (SELECT f, split, coalesce(x, '__MISSING__') AS level, avg(y) AS rate, count(x) AS filled FROM cat GROUP BY 1, 2, 3),
csig AS (SELECT f, split, max(rate) - min(rate) AS score, sum(filled)::BIGINT AS observed, count(*) AS levels FROM clev GROUP BY 1, 2),
sig AS (SELECT * FROM nsig UNION ALL SELECT * FROM csig),
wide AS (SELECT f, max(score) FILTER (split = 'train') AS tr, max(score) FILTER (split = 'test') AS te,
           max(observed) FILTER (split = 'train') AS tro, max(observed) FILTER (split = 'test') AS teo, max(levels) FILTER (split = 'train') AS trl FROM sig GROUP BY 1),
miss AS ({" UNION ALL ".join(f"SELECT '{c}' AS f, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS rate FROM s" for c in SCREEN_NUMERIC + SCREEN_TEXT)}),
screen AS (SELECT f AS feature_name, CASE WHEN f IN {SCREEN_NUMERIC} THEN 'numeric' ELSE 'categorical_or_binary_text' END AS basic_type,
  CASE WHEN f IN {SCREEN_NUMERIC} THEN 'float64' ELSE 'str' END AS dtype, rate AS missing_rate,
  CASE WHEN f IN {SCREEN_NUMERIC} THEN 'single_feature_auroc' ELSE 'target_rate_range' END AS signal_method,
  round(tr, 6) AS train_signal_score, round(te, 6) AS test_signal_score,
  round(CASE WHEN tr IS NULL THEN te WHEN te IS NULL THEN tr ELSE (tr + te) / 2 END, 6) AS average_signal_score,
  tro AS train_observed_count, teo AS test_observed_count, trl AS train_category_count,
  CASE WHEN f IN {SCREEN_NUMERIC} AND greatest(tr, te) >= 0.98 AND least(tr, te) >= 0.95 THEN 1
       WHEN f IN {SCREEN_TEXT} AND tr >= 0.99 AND te >= 0.75 THEN 2 WHEN f IN {SCREEN_TEXT} AND tr >= 0.99 AND te < 0.75 THEN 3 ELSE 4 END AS verdict
  FROM wide JOIN miss USING (f))"""

SCREEN_SQL = f"""
WITH {SCREEN_BODY}
SELECT * EXCLUDE (verdict), CASE WHEN verdict <= 2 THEN 'review' ELSE 'low' END AS leakage_risk_level,
  CASE verdict WHEN 1 THEN {text(LEAKAGE_NOTES['numeric'])} WHEN 2 THEN {text(LEAKAGE_NOTES['categorical'])}
       WHEN 3 THEN {text(LEAKAGE_NOTES['train_only'])} ELSE {text(LEAKAGE_NOTES['none'])} END AS leakage_risk_note
FROM screen"""


def top_features(spark, folder):
    screen = leakage.feature_screen(screen_table(spark, folder), "target")
    return final(leakage.top_features(screen, 3, {"leak": "Derived from the target on purpose."}))


TOP_SQL = f"""
WITH {SCREEN_BODY}
SELECT row_number() OVER (ORDER BY average_signal_score DESC NULLS LAST, test_signal_score DESC NULLS LAST, train_signal_score DESC NULLS LAST, feature_name) AS rank,
  feature_name, basic_type, train_signal_score, test_signal_score, average_signal_score,
  CASE WHEN verdict <= 2 THEN 'review' ELSE 'low' END AS leakage_risk_level,
  CASE WHEN verdict <= 2 THEN 'review_but_clinically_plausible' ELSE 'strong_but_not_obviously_leaky' END AS overall_assessment,
  CASE WHEN feature_name = 'leak' THEN 'Derived from the target on purpose.' ELSE {text(DEFAULT_CONTEXT)} END AS interpretation_note
FROM screen ORDER BY 1 LIMIT 3"""

# --- Intervals and tests --------------------------------------------------------


def label_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Document quality with two scores: text length and a digest."""
    data = table(spark, folder, "documents").select("doc_id", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    u = uniform(SCORE_SEED, F.col("doc_id"))
    scores = {
        "length": F.least(F.col("n_chars") / 4000.0, F.lit(1.0)),
        "mixed": F.round(0.7 * u + 0.3 * F.col("quality"), 4),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("model_name"), s.alias("risk_score")) for m, s in scores.items()])
    long = data.select(F.col("doc_id").alias("row_index"), F.col("quality").alias("target_true"), F.inline(rows))
    return long.withColumn("prediction_label", (F.col("risk_score") >= 0.5).cast("int"))


LABEL_PREDICTIONS = f"""
lbase AS (SELECT doc_id AS row_index, quality AS target_true, n_chars, {sql_hash("'7'", "doc_id")} / 4294967296.0::DOUBLE AS u FROM documents JOIN labels USING (doc_id)),
lscored AS (SELECT row_index, target_true, 'length' AS model_name, least(n_chars / 4000.0::DOUBLE, 1.0::DOUBLE) AS risk_score FROM lbase
  UNION ALL SELECT row_index, target_true, 'mixed', round(0.7::DOUBLE * u + 0.3::DOUBLE * target_true, 4) FROM lbase),
lpred AS (SELECT *, (risk_score >= 0.5::DOUBLE)::INT AS prediction_label FROM lscored)"""

def staged(source: str, columns: str, *steps: tuple[str, str]) -> str:
    """Nested selects that add one column after the other."""
    for name, expression in steps:
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    return f"SELECT {columns} FROM {source}"


def mix_steps(x: str, name: str) -> list[tuple[str, str]]:
    """32 bits spread over 32 bits: twice the exclusive or with the upper half and a product, then the exclusive or."""
    half = "xor({0} >> 16, {0})"
    first = f"({half.format(x)} * 73244475) & 4294967295"
    return [(f"{name}_a", first), (f"{name}_b", f"({half.format(f'{name}_a')} * 73244475) & 4294967295"), (name, half.format(f"{name}_b"))]


#: Splits of one level: the share left of the middle, the number that decides, and the smallest count with that much probability.
SPLIT = staged(
    """(SELECT t.*, sums[least(spot, leaves) + 1] AS s0, sums[least(spot + width // 2, leaves) + 1] AS s1, sums[least(spot + width, leaves) + 1] AS s2
     FROM tree t JOIN running USING (model_name, target_true) WHERE width > 1)""",
    "*",
    ("p", "(s1 - s0) / (s2 - s0)::DOUBLE"),
    ("x0", "(key + node * 2654435769) & 4294967295"),
    *mix_steps("x0", "y1"),
    ("x1", "xor(y1, key)"),
    *mix_steps("x1", "y2"),
    ("u", "((y1 << 20) + (y2 >> 12)) / 4503599627370496.0::DOUBLE"),
    ("masses", "CASE WHEN p > 0 AND p < 1 THEN list_transform(range(m), lambda j: exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * ln(p) + (m - j) * ln(1 - p))) END"),
    ("taken", "CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN m ELSE len(list_filter(range(1, m + 1), lambda j: list_sum(masses[1:j]) < u)) END"),
)

DRAWS = f"""{LABEL_PREDICTIONS},
lcells AS MATERIALIZED (SELECT model_name, risk_score, 2 * (dense_rank() OVER (PARTITION BY model_name ORDER BY risk_score DESC) - 1) + 1 - prediction_label AS leaf, target_true, prediction_label FROM lpred),
lleaves AS MATERIALIZED (SELECT model_name, max(leaf) // 2 * 2 + 2 AS leaves FROM lcells GROUP BY 1),
heights AS MATERIALIZED (SELECT model_name, target_true, any_value(leaves) AS leaves, count(*) AS size, (2 ** ceil(log2(any_value(leaves))))::BIGINT AS width FROM lcells JOIN lleaves USING (model_name) GROUP BY 1, 2),
running AS MATERIALIZED (SELECT model_name, target_true, any_value(leaves) AS leaves, list(n ORDER BY leaf) AS sums FROM (SELECT h.model_name, h.target_true, h.leaf, any_value(leaves) AS leaves, count(c.leaf) AS n
  FROM (SELECT *, unnest(range(leaves + 1)) AS leaf FROM heights) h LEFT JOIN lcells c ON c.model_name = h.model_name AND c.target_true = h.target_true AND c.leaf < h.leaf GROUP BY 1, 2, 3) GROUP BY 1, 2),
tree(model_name, target_true, replicate, key, node, spot, width, m) AS (
  SELECT model_name, target_true, b, {sql_hash("'42'", "model_name", "target_true", "b")}, 1::BIGINT, 0::BIGINT, width, size FROM heights, generate_series(1, {REPLICATES}) g(b)
  UNION ALL SELECT model_name, target_true, replicate, key, 2 * node + side, spot + side * (width // 2), width // 2, CASE side WHEN 0 THEN taken ELSE m - taken END
    FROM ({SPLIT}), (VALUES (0), (1)) sides(side) WHERE CASE side WHEN 0 THEN taken ELSE m - taken END > 0),
resampled AS MATERIALIZED (SELECT replicate, t.model_name, t.target_true, risk_score, prediction_label, unnest(range(m)) AS copy FROM tree t
  JOIN (SELECT DISTINCT model_name, leaf, risk_score, prediction_label FROM lcells) c ON c.model_name = t.model_name AND c.leaf = t.spot WHERE width = 1),
boot AS ({metric_sql("resampled", "model_name, replicate", rounded=False)}),
point AS ({metric_sql("lpred", "model_name", rounded=False)})"""


def bootstrap_replicates(spark, folder):
    return final(bootstrap_metrics(label_predictions(spark, folder)))


BOOT_REPLICATES_SQL = f"WITH RECURSIVE {DRAWS} SELECT model_name, replicate, n_rows, n_positive, n_negative, " + ", ".join(
    f"round({m}, 6) AS {m}" for m in METRICS
) + " FROM boot"


def bootstrap_intervals(spark, folder):
    return final(inference.bootstrap_intervals(label_predictions(spark, folder)))


BOOT_CI_SQL = f"WITH RECURSIVE {DRAWS} " + " UNION ALL ".join(
    f"""SELECT model_name, '{m}' AS metric, round(any_value(point.{m}), 6) AS point_estimate, round(quantile_cont(boot.{m}, 0.025), 6) AS ci_lower,
round(quantile_cont(boot.{m}, 0.975), 6) AS ci_upper, {REPLICATES}::BIGINT AS n_bootstrap, 0.95::DOUBLE AS alpha, 'stratified_percentile' AS bootstrap_method
FROM boot JOIN point USING (model_name) GROUP BY model_name"""
    for m in METRICS
)


def wide_intervals(spark, folder):
    intervals = inference.bootstrap_intervals(label_predictions(spark, folder))
    return final(inference.wide_intervals(final(intervals)).select("model_name", "auroc", "auroc_ci_lower", "auroc_ci_upper", "auroc_with_ci", "brier_score_with_ci"))


BOOT_WIDE_SQL = f"""
WITH RECURSIVE {DRAWS}, w AS (SELECT model_name, round(any_value(point.auroc), 6) AS a, round(quantile_cont(boot.auroc, 0.025), 6) AS al, round(quantile_cont(boot.auroc, 0.975), 6) AS au,
  round(any_value(point.brier_score), 6) AS b, round(quantile_cont(boot.brier_score, 0.025), 6) AS bl, round(quantile_cont(boot.brier_score, 0.975), 6) AS bu
  FROM boot JOIN point USING (model_name) GROUP BY 1)
SELECT model_name, a AS auroc, al AS auroc_ci_lower, au AS auroc_ci_upper, printf('%.3f (%.3f-%.3f)', a, al, au) AS auroc_with_ci,
  printf('%.3f (%.3f-%.3f)', b, bl, bu) AS brier_score_with_ci FROM w"""


def delong(spark, folder):
    tests = inference.delong(predictions(spark, folder), MODELS)
    return final(tests.select("model_a", "model_b", "comparison_label", "auc_model_a", "auc_model_b", "auc_diff", (F.col("variance") * 1e6).alias("variance_e6"), "z_score"))


PLACEMENTS = """
cells AS (SELECT model_name, risk_score, sum(target_true)::DOUBLE AS pos, sum(1 - target_true)::DOUBLE AS neg FROM pred GROUP BY 1, 2),
run AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS bpos, coalesce(sum(neg) OVER w, 0) AS bneg, sum(pos) OVER (PARTITION BY model_name) AS p, sum(neg) OVER (PARTITION BY model_name) AS n
        FROM cells WINDOW w AS (PARTITION BY model_name ORDER BY risk_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT row_index, target_true, model_name, CASE WHEN target_true = 1 THEN (bneg + neg / 2) / n ELSE 1 - (bpos + pos / 2) / p END AS v, p, n
      FROM pred JOIN run USING (model_name, risk_score))"""

DELONG_SQL = f"""
WITH {PREDICTIONS}, {PLACEMENTS},
pair AS (SELECT a.model_name AS model_a, b.model_name AS model_b, a.target_true AS y, a.v AS va, b.v AS vb, a.p, a.n
         FROM v a JOIN v b ON a.row_index = b.row_index
         AND list_position(['coin', 'price', 'blend'], a.model_name) < list_position(['coin', 'price', 'blend'], b.model_name)),
t AS (SELECT model_a, model_b, avg(va) FILTER (y = 1) AS aa, avg(vb) FILTER (y = 1) AS ab,
        var_samp(va - vb) FILTER (y = 1) / any_value(p) + var_samp(va - vb) FILTER (y = 0) / any_value(n) AS variance FROM pair GROUP BY 1, 2)
SELECT model_a, model_b, model_a || ' vs ' || model_b AS comparison_label, round(aa, 6) AS auc_model_a, round(ab, 6) AS auc_model_b,
  round(aa - ab, 6) AS auc_diff, round(variance * 1e6, 6) AS variance_e6, round(abs(aa - ab) / sqrt(variance), 6) AS z_score FROM t"""


def mcnemar(spark, folder):
    tests = inference.mcnemar(predictions(spark, folder), MODELS)
    return final(tests.drop("p_value_raw", "p_value_bonferroni", "reject_bonferroni"))


MCNEMAR_SQL = f"""
WITH {PREDICTIONS},
c AS (SELECT row_index, model_name, target_true = prediction_label AS ok, list_position(['coin', 'price', 'blend'], model_name) AS o FROM pred),
t AS (SELECT a.model_name AS model_a, b.model_name AS model_b, count(*) FILTER (a.ok AND b.ok) AS bc, count(*) FILTER (a.ok AND NOT b.ok) AS ab,
        count(*) FILTER (NOT a.ok AND b.ok) AS ba, count(*) FILTER (NOT a.ok AND NOT b.ok) AS bw, count(*) AS n
      FROM c a JOIN c b ON a.row_index = b.row_index AND a.o < b.o GROUP BY 1, 2)
SELECT model_a, model_b, model_a || ' vs ' || model_b AS comparison_label, round((bc + ab) / n, 6) AS accuracy_model_a, round((bc + ba) / n, 6) AS accuracy_model_b,
  round((ab - ba) / n, 6) AS accuracy_diff, bc AS both_correct, ab AS a_correct_b_wrong, ba AS a_wrong_b_correct, bw AS both_wrong,
  ab + ba AS discordant_total, least(ab, ba)::DOUBLE AS statistic FROM t"""


def test_p_values(spark, folder):
    """p-values and Bonferroni decisions of both test families, three pairs each."""
    p = predictions(spark, folder)
    keep = ["family", "model_a", "model_b", "p_value_raw", "p_value_bonferroni", "reject_bonferroni"]
    a = inference.delong(p, MODELS).withColumn("family", F.lit("delong")).select(*keep)
    b = inference.mcnemar(p, MODELS).withColumn("family", F.lit("mcnemar")).select(*keep)
    return final(a.unionByName(b))


#: Two-sided normal tail of z by the series of the error function whose terms are all positive.
NORMAL_TAIL = """1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 300), lambda j: exp((2 * j + 1) * ln(greatest(z, 1e-12::DOUBLE) / sqrt(2::DOUBLE)) + j * ln(2::DOUBLE)
  - (lgamma(2 * j + 2.0::DOUBLE) - lgamma(j + 1.0::DOUBLE) - j * ln(2::DOUBLE)))))"""
P_VALUES_SQL = f"""
WITH z AS ({DELONG_SQL.replace("round(abs(aa - ab) / sqrt(variance), 6) AS z_score", "least(abs(aa - ab) / sqrt(variance), 12.0::DOUBLE) AS z")}),
m AS (SELECT model_a, model_b, discordant_total AS n, statistic::BIGINT AS k FROM ({MCNEMAR_SQL})),
p AS (SELECT 'delong' AS family, model_a, model_b, greatest({NORMAL_TAIL}, 0.0::DOUBLE) AS p FROM z
 UNION ALL SELECT 'mcnemar', model_a, model_b, least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) - n * ln(2.0::DOUBLE))))) FROM m)
SELECT family, model_a, model_b, round(p, 6) AS p_value_raw, round(least(1.0::DOUBLE, 3 * p), 6) AS p_value_bonferroni, 3 * p < 0.05 AS reject_bonferroni FROM p"""


MCNEMAR_P_SQL = f"""
WITH {LABEL_PREDICTIONS},
w AS (SELECT row_index, max((target_true = prediction_label)::INT) FILTER (model_name = 'length') AS a, max((target_true = prediction_label)::INT) FILTER (model_name = 'mixed') AS b FROM lpred GROUP BY 1),
t AS (SELECT count(*) FILTER (a = 1 AND b = 0) AS x, count(*) FILTER (a = 0 AND b = 1) AS y FROM w),
s AS (SELECT x + y AS n, least(x, y) AS k FROM t)
SELECT 'length' AS model_a, 'mixed' AS model_b, round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) - n * ln(2.0::DOUBLE))) FROM generate_series(0, (SELECT k FROM s)) g(i))), 6) AS p_value_raw FROM s"""


def mcnemar_p(spark, folder):
    return final(inference.mcnemar(label_predictions(spark, folder), ("length", "mixed")).select("model_a", "model_b", "p_value_raw"))


QUERIES = {
    "split_many_strata": split_many_strata,
    "metrics_null_model": metrics_null_model,
    "flagship_document_metrics": flagship,
    "split_stratified": split_rows,
    "split_folds": folds,
    "split_check": split_check,
    "split_selection": split_selection,
    "split_leakage": split_leakage,
    "split_overlap_examples": overlap_examples,
    "metrics_by_model": metric_table,
    "metrics_confusion": confusion,
    "metrics_lineitem_auroc": lineitem_auroc,
    "metrics_roc_curve": roc_curve,
    "metrics_pr_curve": pr_curve,
    "metrics_calibration": calibration,
    "metrics_fold_summary": fold_summary,
    "metrics_best_model": best_model,
    "metrics_fallback_best": fallback_best,
    "metrics_comparison": comparison,
    "metrics_long_table": long_table,
    "metrics_prediction_alignment": alignment,
    "ranking_midranks": midranks,
    "ranking_exact_quantiles": quantiles,
    "leakage_feature_screen": feature_screen,
    "leakage_top_features": top_features,
    "bootstrap_replicates": bootstrap_replicates,
    "bootstrap_intervals": bootstrap_intervals,
    "bootstrap_wide_intervals": wide_intervals,
    "tests_delong": delong,
    "tests_mcnemar": mcnemar,
    "tests_mcnemar_p": mcnemar_p,
    "tests_p_values": test_p_values,
}
ORACLE = {
    "split_many_strata": MANY_STRATA_SQL,
    "metrics_null_model": METRICS_NULL_SQL,
    "flagship_document_metrics": FLAGSHIP_SQL,
    "split_stratified": SPLIT_SQL,
    "split_folds": FOLDS_SQL,
    "split_check": SPLIT_CHECK_SQL,
    "split_selection": SPLIT_SELECTION_SQL,
    "split_leakage": SPLIT_LEAKAGE_SQL,
    "split_overlap_examples": OVERLAP_SQL,
    "metrics_by_model": METRICS_SQL,
    "metrics_confusion": CONFUSION_SQL,
    "metrics_lineitem_auroc": LINEITEM_AUROC_SQL,
    "metrics_roc_curve": ROC_SQL,
    "metrics_pr_curve": PR_SQL,
    "metrics_calibration": CALIBRATION_SQL,
    "metrics_fold_summary": FOLD_SUMMARY_SQL,
    "metrics_best_model": BEST_MODEL_SQL,
    "metrics_fallback_best": FALLBACK_SQL,
    "metrics_comparison": COMPARISON_SQL,
    "metrics_long_table": LONG_SQL,
    "metrics_prediction_alignment": ALIGNMENT_SQL,
    "ranking_midranks": MIDRANKS_SQL,
    "ranking_exact_quantiles": QUANTILES_SQL,
    "leakage_feature_screen": SCREEN_SQL,
    "leakage_top_features": TOP_SQL,
    "bootstrap_replicates": BOOT_REPLICATES_SQL,
    "bootstrap_intervals": BOOT_CI_SQL,
    "bootstrap_wide_intervals": BOOT_WIDE_SQL,
    "tests_delong": DELONG_SQL,
    "tests_mcnemar": MCNEMAR_SQL,
    "tests_mcnemar_p": MCNEMAR_P_SQL,
    "tests_p_values": P_VALUES_SQL,
}
