"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from riskloom.operators.keys import join_groups

NUMERIC, CATEGORICAL = "numeric", "categorical_or_binary_text"


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def dtype_name(data_type: T.DataType) -> str:
    """Column type in the vocabulary of data-frame libraries."""
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float64"
    if isinstance(data_type, T.IntegralType):
        return "int64"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    return "str"


def missing_cell(df: DataFrame, column: str) -> Column:
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, missing count and missing share of every column, in one pass."""
    columns = list(df.columns if columns is None else columns)
    one_row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(dtype_name(df.schema[c].dataType)).alias("dtype"),
                    F.count_if(missing_cell(df, c)).alias("missing_count"),
                )
                for c in columns
            ]
        ).alias("_columns"),
    )
    return one_row.select("_rows", F.inline("_columns")).select(
        "column",
        "dtype",
        "missing_count",
        F.coalesce(F.try_divide(F.col("missing_count"), F.col("_rows")), F.lit(0.0)).alias("missing_ratio"),
    )


def type_plan(df: DataFrame, target: str) -> DataFrame:
    """Feature list with its modelling type and missingness."""
    features = [c for c in df.columns if c != target]
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    return missingness(df, features).select(
        F.col("column").alias("feature_name"),
        "dtype",
        F.when(F.col("column").isin(*numeric), NUMERIC).otherwise(CATEGORICAL).alias("inferred_feature_type"),
        "missing_count",
        "missing_ratio",
    )


def feature_lists(df: DataFrame, target: str, skip: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and text features, read from the schema."""
    features = [c for c in df.columns if c != target and c not in skip]
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    return numeric, [c for c in features if c not in numeric]


def shares(counts: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Add the share of each count; the totals are aggregated, never windowed over one task."""
    totals = counts.groupBy(*within).agg(F.sum("row_count").alias("_total"))
    if within:
        joined = join_groups(counts, totals, within)
        return joined.withColumn("ratio", F.col("row_count") / F.col("_total")).drop("_total")
    return counts.withColumn("ratio", F.col("row_count") / counts.agg(F.sum("row_count")).scalar())


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value, missing included."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
    return shares(counts)


def first_seen(df: DataFrame, column: str, row_key: str) -> DataFrame:
    """Distinct values with the smallest row key that carries them."""
    return df.groupBy(F.col(column).alias("value")).agg(F.min(row_key).alias("first_row"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a row that keeps missing cells apart from any text."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows.

    Rows are shuffled as 32-byte digests, not as whole records, and equal rows
    collapse before the shuffle.
    """
    columns = list(df.columns if columns is None else columns)
    groups = df.groupBy(F.unhex(fingerprint(df, columns)).alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def inline_rows(names: Sequence[str], *rows: Sequence[Column]) -> Column:
    """Several rows out of one, under the given column names."""
    return F.inline(F.array(*[F.struct(*[v.alias(n) for n, v in zip(names, row)]) for row in rows]))


def profile(df: DataFrame, target: str) -> DataFrame:
    """Long profile document: (section, item, measure, value)."""
    n_columns = len(df.columns)
    names = ("measure", "value")
    head = duplicate_rows(df).select(
        F.lit("table").alias("section"),
        F.lit("").alias("item"),
        inline_rows(
            names,
            (F.lit("num_rows"), F.col("total_rows").cast("double")),
            (F.lit("num_columns"), F.lit(float(n_columns))),
            (F.lit("num_feature_columns"), F.lit(float(n_columns - 1))),
            (F.lit("duplicate_row_count"), F.col("duplicate_row_count").cast("double")),
        ),
    )
    columns = missingness(df).select(
        F.lit("column").alias("section"),
        F.col("column").alias("item"),
        inline_rows(
            names,
            (F.lit("missing_count"), F.col("missing_count").cast("double")),
            (F.lit("missing_ratio"), F.col("missing_ratio")),
        ),
    )
    classes = distribution(df, target).select(
        F.lit("target").alias("section"),
        F.coalesce(F.col("value").cast("string"), F.lit("<NA>")).alias("item"),
        inline_rows(names, (F.lit("count"), F.col("row_count").cast("double")), (F.lit("ratio"), F.col("ratio"))),
    )
    return head.unionByName(columns).unionByName(classes)


def profile_document(df: DataFrame, target: str, dataset_id: str, dataset_name: str) -> DataFrame:
    """The profile as one JSON text; its size depends on the columns and classes only."""
    entries = profile(df, target).groupBy("section", "item").agg(
        F.array_sort(F.collect_list(F.struct("measure", "value"))).alias("measures")
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("section", "item", "measures"))),
        lambda e: F.struct(
            e["section"].alias("section"),
            e["item"].alias("item"),
            F.map_from_entries(e["measures"]).alias("measures"),
        ),
    )
    schema = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(dtype_name(f.dataType)))])
    return entries.agg(
        F.to_json(
            F.struct(
                F.lit(dataset_id).alias("dataset_id"),
                F.lit(dataset_name).alias("dataset_name"),
                F.lit(target).alias("target_column"),
                schema.alias("dtypes"),
                ordered.alias("entries"),
            )
        ).alias("document")
    )


def class_distribution(df: DataFrame, target: str, groups: Sequence[str] = ()) -> DataFrame:
    """Total, count and share of each class, per group when asked for."""
    filled = df.filter(F.col(target).isNotNull())
    counts = filled.groupBy(*groups, F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("row_count"))
    return shares(counts, groups)


def target_breakdown(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Value counts of a feature inside every target class."""
    value = F.coalesce(F.col(feature).cast("string"), F.lit("<NA>"))
    return df.groupBy(F.col(target).alias("target"), value.alias("value")).agg(F.count(F.lit(1)).alias("row_count"))


def nested_breakdown(breakdown: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The breakdown as one nested map per key, for report documents."""
    inner = breakdown.groupBy(*keys, "target").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "row_count")))).alias("counts")
    )
    return inner.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("target").cast("string"), F.col("counts")))).alias(
            "breakdown"
        )
    )


def setup_summary(df: DataFrame, target: str, split: DataFrame | None = None) -> DataFrame:
    """Row, feature, class and type counts as one long table."""
    numeric, text = feature_lists(df, target)
    everything = F.lit("all")
    facts = df.agg(F.count(F.lit(1)).alias("n")).select(
        inline_rows(
            ("item", "part", "value"),
            (F.lit("rows"), everything, F.col("n")),
            (F.lit("features"), everything, F.lit(len(numeric) + len(text)).cast("long")),
            (F.lit("features"), F.lit(NUMERIC), F.lit(len(numeric)).cast("long")),
            (F.lit("features"), F.lit(CATEGORICAL), F.lit(len(text)).cast("long")),
        )
    )
    parts = [(df.withColumn("_part", F.lit("all")), target)]
    if split is not None:
        parts.append((split.withColumn("_part", F.col("split")), "target"))
    for table, column in parts:
        counts = table.groupBy("_part", F.col(column).alias("_class")).agg(F.count(F.lit(1)).alias("value"))
        facts = facts.unionByName(
            counts.select(
                F.concat(F.lit("class_"), F.col("_class").cast("string")).alias("item"),
                F.col("_part").alias("part"),
                "value",
            )
        )
    return facts


def first_values(
    distinct: DataFrame, groups: Sequence[str], order: Column, value: str, limit: int | None
) -> DataFrame:
    """The first distinct values per group as an array.

    With a limit the rank filter is applied on each task before the shuffle, so
    a group with many values sends only `limit` of them. Without one the caller
    must know that the values come from a bounded set.
    """
    placed = distinct.withColumn("_order", order)
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy("_order"))
        placed = placed.withColumn("_place", rank).filter(F.col("_place") <= limit)
    pairs = F.array_sort(F.collect_list(F.struct("_order", F.col(value).alias("_v"))))
    return placed.groupBy(*groups).agg(F.transform(pairs, lambda s: s["_v"]).alias("values"))
