"""Profiles, cleaning and label encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text as X
from riskloom.operators import clean, contracts, profile
from riskloom.queries.common import final, table
from riskloom.sources.tables import load_dataset

LABELS = {"F": 1, "O": 0}


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; most documents have none, which gives real missing cells."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")


LABELLED = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def missingness(spark, folder):
    return final(profile.missingness(labelled_documents(spark, folder)))


def type_plan(spark, folder):
    return final(profile.type_plan(labelled_documents(spark, folder).drop("doc_id"), "quality"))


def _missing_sql(columns: dict[str, str], source: str, head: str) -> str:
    parts = [
        f"SELECT '{c}' AS {head}, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS missing_count, "
        f"round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_ratio FROM t"
        for c, t in columns.items()
    ]
    return f"WITH t AS ({source}) " + " UNION ALL ".join(parts)


MISSINGNESS_SQL = _missing_sql(
    {"doc_id": "int64", "lang": "str", "source": "str", "n_chars": "int64", "quality": "int64", "toxic": "int64"},
    LABELLED,
    "\"column\"",
)
TYPE_PLAN_SQL = (
    "SELECT feature_name, dtype, CASE WHEN dtype = 'str' THEN 'categorical_or_binary_text' ELSE 'numeric' END "
    "AS inferred_feature_type, missing_count, missing_ratio FROM ("
    + _missing_sql({"lang": "str", "source": "str", "n_chars": "int64", "toxic": "int64"}, LABELLED, "feature_name")
    + ")"
)


def distribution(spark, folder):
    return final(profile.distribution(table(spark, folder, "orders"), "o_orderpriority"))


DISTRIBUTION_SQL = """
SELECT o_orderpriority AS value, count(*) AS row_count, round(count(*) / sum(count(*)) OVER (), 6) AS ratio
FROM orders GROUP BY 1"""


def first_seen(spark, folder):
    return final(profile.first_seen(table(spark, folder, "orders"), "o_orderpriority", "o_orderkey"))


FIRST_SEEN_SQL = "SELECT o_orderpriority AS value, min(o_orderkey) AS first_row FROM orders GROUP BY 1"


def duplicates(spark, folder):
    return final(profile.duplicate_rows(table(spark, folder, "documents"), ["text", "lang"]))


DUPLICATES_SQL = """
SELECT count(*) AS total_rows, count(DISTINCT (text, lang)) AS distinct_rows,
       count(*) - count(DISTINCT (text, lang)) AS duplicate_row_count FROM documents"""


def profile_table(spark, folder):
    return final(profile.profile(labelled_documents(spark, folder).drop("doc_id"), "quality"))


PROFILE_SQL = f"""
WITH t AS (SELECT lang, source, n_chars, quality, toxic FROM ({LABELLED}))
SELECT 'table' AS section, '' AS item, 'num_rows' AS measure, count(*)::DOUBLE AS value FROM t
UNION ALL SELECT 'table', '', 'num_columns', 5.0::DOUBLE
UNION ALL SELECT 'table', '', 'num_feature_columns', 4.0::DOUBLE
UNION ALL SELECT 'table', '', 'duplicate_row_count', (count(*) - count(DISTINCT (lang, source, n_chars, quality, toxic)))::DOUBLE FROM t
""" + "".join(
    f"""UNION ALL SELECT 'column', '{c}', 'missing_count', (count(*) FILTER ({c} IS NULL))::DOUBLE FROM t
UNION ALL SELECT 'column', '{c}', 'missing_ratio', round(count(*) FILTER ({c} IS NULL) / count(*), 6) FROM t
"""
    for c in ("lang", "source", "n_chars", "quality", "toxic")
) + """UNION ALL SELECT 'target', coalesce(quality::VARCHAR, '<NA>'), 'count', count(*)::DOUBLE FROM t GROUP BY quality
UNION ALL SELECT 'target', coalesce(quality::VARCHAR, '<NA>'), 'ratio', round(count(*) / (SELECT count(*) FROM t), 6) FROM t GROUP BY quality"""


def class_balance(spark, folder):
    return final(profile.class_distribution(labelled_documents(spark, folder), "quality", ["lang"]))


CLASS_BALANCE_SQL = f"""
SELECT lang, quality::BIGINT AS target, count(*) AS row_count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS ratio
FROM ({LABELLED}) WHERE quality IS NOT NULL GROUP BY 1, 2"""


def null_group(spark, folder):
    """Documents without a language are a group of their own."""
    docs = labelled_documents(spark, folder).withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    return final(profile.class_distribution(docs, "quality", ["lang"]))


NULL_GROUP_SQL = f"""
SELECT nullif(lang, 'de') AS lang, quality::BIGINT AS target, count(*) AS row_count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY nullif(lang, 'de')), 6) AS ratio
FROM ({LABELLED}) WHERE quality IS NOT NULL GROUP BY 1, 2"""


def breakdown(spark, folder):
    return final(profile.target_breakdown(labelled_documents(spark, folder), "toxic", "lang"))


BREAKDOWN_SQL = f"""
SELECT lang AS target, coalesce(toxic::VARCHAR, '<NA>') AS value, count(*) AS row_count
FROM ({LABELLED}) GROUP BY 1, 2"""


def nested_breakdown(spark, folder):
    """Counts of toxic labels per language as one map per part of the documents, written out by key."""
    counts = labelled_documents(spark, folder).groupBy("source", F.col("lang").alias("target"), F.coalesce(F.col("toxic").cast("string"), F.lit("<NA>")).alias("value"))
    nested = profile.nested_breakdown(counts.agg(F.count(F.lit(1)).alias("row_count")), ["source"])
    inner = nested.select("source", F.explode("breakdown").alias("target", "counts")).select("source", "target", F.explode("counts").alias("value", "row_count"))
    return final(inner)


NESTED_SQL = f"""
SELECT source, lang AS target, coalesce(toxic::VARCHAR, '<NA>') AS value, count(*) AS row_count FROM ({LABELLED}) GROUP BY 1, 2, 3"""


def setup(spark, folder):
    data = labelled_documents(spark, folder).drop("doc_id").filter("quality is not null")
    return final(profile.setup_summary(data, "quality"))


SETUP_SQL = f"""
WITH t AS (SELECT * FROM ({LABELLED}) WHERE quality IS NOT NULL)
SELECT 'rows' AS item, 'all' AS part, count(*) AS value FROM t
UNION ALL SELECT 'features', 'all', 4
UNION ALL SELECT 'features', 'numeric', 2
UNION ALL SELECT 'features', 'categorical_or_binary_text', 2
UNION ALL SELECT 'class_' || quality, 'all', count(*) FROM t GROUP BY quality"""


def dirty_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Part columns as a badly exported file has them: padding, blanks and numbers as text."""
    key = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    return table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit(" "), F.col("p_name"), F.lit("\t")).alias("name"),
        F.concat(F.lit("\t"), size, F.lit(" \n")).alias("size"),
        F.when(key % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).alias("price"),
        F.when(key % 5 == 0, F.lit("?")).otherwise(size).alias("mixed"),
    )


DIRTY = r"""
SELECT p_partkey, ' ' || p_name || chr(9) AS name, chr(9) || p_size || ' ' || chr(10) AS size,
       CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE ' ' || p_retailprice::VARCHAR END AS price,
       CASE WHEN p_partkey % 5 = 0 THEN '?' ELSE p_size::VARCHAR END AS mixed FROM part"""


def minimal_clean(spark, folder):
    return final(clean.minimal_clean(dirty_parts(spark, folder)))


MINIMAL_CLEAN_SQL = rf"""
SELECT p_partkey, trim(name, ' ' || chr(9)) AS name,
       trim(size, ' ' || chr(9) || chr(10))::DOUBLE AS size,
       TRY_CAST(nullif(trim(price), '') AS DOUBLE) AS price, mixed FROM ({DIRTY})"""


def numeric_verdict(spark, folder):
    return final(clean.numeric_verdict(clean.trim_cells(dirty_parts(spark, folder))))


NUMERIC_VERDICT_SQL = rf"""
WITH t AS (SELECT trim(name, ' ' || chr(9)) AS name, trim(size, ' ' || chr(9) || chr(10)) AS size,
                  nullif(trim(price), '') AS price, mixed FROM ({DIRTY}))
""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS filled, count(TRY_CAST({c} AS DOUBLE)) AS numeric,
        count({c}) > 0 AND count({c}) = count(TRY_CAST({c} AS DOUBLE)) AS coerced FROM t"""
    for c in ("name", "size", "price", "mixed")
)


def encode_labels(spark, folder):
    known = table(spark, folder, "orders").filter(F.col("o_orderstatus").isin(*LABELS))
    encoded = clean.encode_labels(known, "o_orderstatus", LABELS)
    return final(encoded.groupBy("o_orderstatus", "target").agg(F.count(F.lit(1)).alias("row_count")))


ENCODE_SQL = """
SELECT o_orderstatus, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END)::BIGINT AS target, count(*) AS row_count
FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2"""


def unresolved(spark, folder):
    return final(clean.unresolved_labels(table(spark, folder, "orders"), "o_orderstatus", LABELS))


UNRESOLVED_SQL = """
SELECT o_orderstatus AS value, count(*) AS row_count FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1"""


def target_domain(spark, folder):
    target = clean.label_column(F.col("o_orderstatus"), LABELS)
    orders = table(spark, folder, "orders").select("o_orderpriority", target.alias("target"))
    return final(contracts.target_domain(orders, "target", ["o_orderpriority"]))


TARGET_DOMAIN_SQL = """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS zeros, count(*) FILTER (o_orderstatus = 'F') AS ones,
       0::BIGINT AS others, count(*) FILTER (o_orderstatus = 'P') AS missing, true AS is_binary
FROM orders GROUP BY 1"""


def names(spark, folder):
    spelled = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" / "), F.col("p_name"), F.lit(" (Type) "))
    return final(
        table(spark, folder, "part")
        .select(X.normalized_name(spelled).alias("normalized"))
        .groupBy("normalized")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


NAMES_SQL = """
SELECT trim(regexp_replace(lower(' ' || p_brand || ' / ' || p_name || ' (Type) '), '[^a-z0-9]+', '_', 'g'), '_') AS normalized,
       count(*) AS row_count FROM part GROUP BY 1"""


def signatures(spark, folder):
    items = table(spark, folder, "lineitem")
    value = F.explode(
        F.array(
            F.col("l_quantity"),
            F.col("l_extendedprice"),
            F.col("l_discount"),
            F.col("l_extendedprice") * 100000,
            F.col("l_tax") / 100000,
        )
    )
    counts = items.select(value.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return final(counts.groupBy(X.number_text(F.col("v")).alias("signature")).agg(F.sum("n").alias("row_count")))


SIGNATURES_SQL = """
SELECT CASE WHEN v = floor(v) AND abs(v) < 1e15 THEN v::BIGINT::VARCHAR ELSE printf('%g', v) END AS signature, count(*) AS row_count
FROM (SELECT unnest([l_quantity, l_extendedprice, l_discount, l_extendedprice * 100000, l_tax / 100000]) AS v FROM lineitem)
GROUP BY 1"""


def joined_dataset(spark, folder):
    data = load_dataset(
        table(spark, folder, "documents").select("doc_id", "lang", "n_chars"),
        table(spark, folder, "labels"),
        "doc_id",
        "quality",
    )
    return final(
        data.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("row_count"), F.sum("n_chars").alias("n_chars"))
    )


JOINED_SQL = """
SELECT lang, quality::BIGINT AS quality, count(*) AS row_count, sum(n_chars)::BIGINT AS n_chars
FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2"""

QUERIES = {
    "profile_null_group": null_group,
    "profile_missingness": missingness,
    "profile_type_plan": type_plan,
    "profile_distribution": distribution,
    "profile_first_seen_values": first_seen,
    "profile_duplicate_rows": duplicates,
    "profile_table": profile_table,
    "profile_class_balance": class_balance,
    "profile_nested_breakdown": nested_breakdown,
    "profile_target_breakdown": breakdown,
    "profile_setup_summary": setup,
    "clean_minimal": minimal_clean,
    "clean_numeric_verdict": numeric_verdict,
    "clean_encode_labels": encode_labels,
    "clean_unresolved_labels": unresolved,
    "clean_target_domain": target_domain,
    "text_normalized_names": names,
    "text_value_signatures": signatures,
    "source_features_and_targets": joined_dataset,
}
ORACLE = {
    "profile_null_group": NULL_GROUP_SQL,
    "profile_missingness": MISSINGNESS_SQL,
    "profile_type_plan": TYPE_PLAN_SQL,
    "profile_distribution": DISTRIBUTION_SQL,
    "profile_first_seen_values": FIRST_SEEN_SQL,
    "profile_duplicate_rows": DUPLICATES_SQL,
    "profile_table": PROFILE_SQL,
    "profile_class_balance": CLASS_BALANCE_SQL,
    "profile_nested_breakdown": NESTED_SQL,
    "profile_target_breakdown": BREAKDOWN_SQL,
    "profile_setup_summary": SETUP_SQL,
    "clean_minimal": MINIMAL_CLEAN_SQL,
    "clean_numeric_verdict": NUMERIC_VERDICT_SQL,
    "clean_encode_labels": ENCODE_SQL,
    "clean_unresolved_labels": UNRESOLVED_SQL,
    "clean_target_domain": TARGET_DOMAIN_SQL,
    "text_normalized_names": NAMES_SQL,
    "text_value_signatures": SIGNATURES_SQL,
    "source_features_and_targets": JOINED_SQL,
}
