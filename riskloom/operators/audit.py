"""Representation audit of features, repair rules and safe repairs.

Features become rows once: a table of distinct tokens (feature, token, rows)
carries all later decisions, so no step loops over columns or re-reads data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskloom.fixed import (
    BINARY_VOCABULARIES,
    DIRECTION_NOTES,
    EXCEL_WARNING,
    LOW_CARDINALITY_LIMIT,
    PRE_BINNED_REASON,
    RULE_NOTES,
    TYPE_NOTES,
    FeatureGroups,
)
from riskloom.functions.text import (
    coarse_interval,
    coarse_spreadsheet_date,
    interval,
    looks_numeric,
    reasons,
    signature,
    strict_spreadsheet_date,
    token,
    within,
)
from riskloom.operators.profile import dtype_name, first_values, is_numeric, missing_cell
from riskloom.session import shuffle_partitions

BINARY_TYPES = (
    "binary_numeric",
    "binary_numeric_text",
    "binary_text_yes_no",
    "binary_text_present_absent",
    "binary_text_normal_abnormal",
    "binary_text_good_poor",
)
NUMERIC_TYPES = (
    "numeric_continuous",
    "numeric_text_continuous",
    "numeric_low_cardinality",
    "numeric_text_low_cardinality",
)
MISMATCHES = ("binary_encoding_mismatch", "numeric_vs_binned_or_text_numeric", "representation_mismatch")


def long_cells(df: DataFrame, features: Sequence[str], row_key: str | None = None) -> DataFrame:
    """(feature, is_numeric, dtype, raw, row): one row per cell, missing cells included."""
    keep = [F.col(row_key).alias("row")] if row_key else []
    entries = []
    for f in features:
        kind = df.schema[f].dataType
        numeric = is_numeric(kind)
        value = F.when(missing_cell(df, f), None).otherwise(F.col(f))
        entries.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(numeric).alias("is_numeric"),
                F.lit(dtype_name(kind)).alias("dtype"),
                value.cast("string").alias("raw"),
            )
        )
    return df.select(*keep, F.inline(F.array(*entries)))


def tokens(cells: DataFrame, row_key: bool = False) -> DataFrame:
    """Distinct cell texts per feature with their row counts (and first row)."""
    extra = [F.min("row").alias("first_row")] if row_key else []
    return cells.groupBy("feature", "is_numeric", "dtype", "raw").agg(F.count(F.lit(1)).alias("row_count"), *extra)


def cell_signature() -> Column:
    """Comparable text of a cell, made once per distinct value."""
    raw = F.col("raw")
    return F.when(F.col("is_numeric"), signature(raw.try_cast("double"), True)).otherwise(signature(raw, False))


def sides(a_tokens: DataFrame, b_tokens: DataFrame) -> DataFrame:
    """Token tables of two sources as one, so that both are audited in the same pass."""
    return a_tokens.withColumn("side", F.lit("a")).unionByName(b_tokens.withColumn("side", F.lit("b")))


def by_side(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature with `<column>_a` and `<column>_b`; features of one side only are dropped."""
    wide = table.groupBy("feature").agg(
        F.count_distinct("side").alias("_sides"),
        *[F.max_by(c, F.when(F.col("side") == s, F.lit(1))).alias(f"{c}_{s}") for c in columns for s in "ab"],
    )
    return wide.filter("_sides = 2").drop("_sides")


_all = F.bool_and


def signatures(distinct: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct comparable texts; two numbers may share their six-digit text."""
    return distinct.groupBy(*keys, "is_numeric", "dtype", cell_signature().alias("signature")).agg(
        F.sum("row_count").alias("row_count")
    )


def coarse_types(per_signature: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Coarse representation type, warnings and counts per feature, from `signatures`."""
    text = F.col("signature")
    flags = per_signature.groupBy(*keys, "is_numeric", "dtype").agg(
        F.coalesce(F.sum(F.when(text.isNotNull(), F.col("row_count"))), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.sum(F.when(text.isNull(), F.col("row_count"))), F.lit(0)).alias("missing_count"),
        F.count(text).alias("unique_count"),
        F.bool_or(coarse_spreadsheet_date(text)).alias("dates"),
        _all(coarse_interval(text)).alias("intervals"),
        _all(looks_numeric(text)).alias("numbers"),
        _all(text.isin("0", "1")).alias("zero_one"),
        *[_all(within(text, words)).alias(name) for name, words in BINARY_VOCABULARIES.items()],
    )
    low = F.col("unique_count") <= LOW_CARDINALITY_LIMIT
    kind = F.when(F.col("unique_count") == 0, "all_missing")
    kind = kind.when(F.col("is_numeric") & F.col("zero_one"), "binary_numeric")
    kind = kind.when(F.col("is_numeric") & low, "numeric_low_cardinality")
    kind = kind.when(F.col("is_numeric"), "numeric_continuous")
    kind = kind.when(F.col("intervals"), "interval_text_bins")
    for name in BINARY_VOCABULARIES:
        kind = kind.when(F.col(name), name)
    kind = kind.when(F.col("numbers") & F.col("zero_one"), "binary_numeric_text")
    kind = kind.when(F.col("numbers") & low, "numeric_text_low_cardinality")
    kind = kind.when(F.col("numbers"), "numeric_text_continuous").otherwise("categorical_text")
    warned = ~F.col("is_numeric") & F.coalesce(F.col("dates"), F.lit(False))
    return flags.select(
        *keys,
        "dtype",
        "non_null_count",
        "missing_count",
        "unique_count",
        kind.alias("representation"),
        reasons((warned, EXCEL_WARNING)).alias("warnings"),
    )


def normalised(distinct: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Distinct normalised tokens with their first row; a feature without values keeps one missing token."""
    return distinct.groupBy(*keys, "is_numeric", "dtype", token(F.col("raw")).alias("token")).agg(
        F.min("first_row").alias("first_row"),
        _all(F.col("raw").try_cast("double").isin(0.0, 1.0)).alias("zero_one_number"),
    )


def strict_types(tokens_: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Strict representation type per feature and its spreadsheet-damaged tokens, from `normalised`.

    The damaged tokens match `dd-xxx`, so even a hostile column has a bounded list.
    """
    text = F.col("token")
    flags = tokens_.groupBy(*keys, "is_numeric", "dtype").agg(
        F.count(text).alias("n"),
        F.collect_list(F.when(strict_spreadsheet_date(text), F.struct("first_row", "token"))).alias("dates"),
        _all(interval(text).isNotNull() | text.isNull()).alias("intervals"),
        _all(looks_numeric(text)).alias("numbers"),
        _all(text.isin("0", "1")).alias("zero_one"),
        _all("zero_one_number").alias("zero_one_number"),
        *[_all(within(text, words)).alias(name) for name, words in BINARY_VOCABULARIES.items()],
    )
    low = F.col("n") <= LOW_CARDINALITY_LIMIT
    vocabulary = F.lit(False)
    for name in BINARY_VOCABULARIES:
        vocabulary = vocabulary | F.col(name)
    numeric = F.col("is_numeric")
    kind = (
        F.when(F.col("n") == 0, "unresolved")
        .when(numeric & F.col("zero_one_number"), "binary_numeric")
        .when(numeric & low, "ordinal_numeric")
        .when(numeric, "continuous_numeric")
        .when(F.size("dates") > 0, "excel_like_corrupted_token")
        .when(F.col("intervals"), "interval_text")
        .when(vocabulary, "binary_text")
        .when(F.col("numbers") & F.col("zero_one"), "binary_numeric")
        .when(F.col("numbers") & low, "ordinal_numeric")
        .when(F.col("numbers"), "continuous_numeric")
        .otherwise("categorical_text")
    )
    damaged = F.transform(F.array_sort("dates"), lambda d: d["token"])
    return flags.select(*keys, "dtype", kind.alias("representation"), damaged.alias("excel_like_tokens"))


def examples(tokens_: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """First-seen tokens and first-seen interval tokens per feature, at most `limit` of each."""
    kinds = F.array_compact(F.array(F.lit("all"), F.when(interval(F.col("token")).isNotNull(), "interval")))
    tagged = tokens_.filter("token is not null").select(*keys, "token", "first_row", F.explode(kinds).alias("kind"))
    found = first_values(tagged, [*keys, "kind"], F.col("first_row"), "token", limit)
    return found.groupBy(*keys).agg(
        F.max_by("values", F.when(F.col("kind") == "all", F.lit(1))).alias("unique_examples"),
        F.max_by("values", F.when(F.col("kind") == "interval", F.lit(1))).alias("interval_examples"),
    )


def consistency(a: Column, b: Column) -> Column:
    """Status of a pair of coarse types."""
    same = a == b
    ranged = a.isin("numeric_continuous", "numeric_text_continuous", "numeric_low_cardinality", "interval_text_bins")
    numeric = (*NUMERIC_TYPES, "interval_text_bins")
    return (
        F.when(same & ranged, "same_family_but_value_audit_needed")
        .when(same, "same_representation_family")
        .when(a.isin(*BINARY_TYPES) & b.isin(*BINARY_TYPES), "binary_encoding_mismatch")
        .when(a.isin(*numeric) & b.isin(*numeric), "numeric_vs_binned_or_text_numeric")
        .otherwise("representation_mismatch")
    )


def consistency_action(status: Column) -> Column:
    return (
        F.when(status == "same_family_but_value_audit_needed", "review_value_ranges")
        .when(status == "same_representation_family", "review_category_values")
        .otherwise("manual_review_required")
    )


def modelling_type(a: Column, b: Column, action: Column) -> Column:
    continuous = ("numeric_continuous", "numeric_text_continuous")
    low = ("numeric_low_cardinality", "numeric_text_low_cardinality")
    return (
        F.when(action == "manual_review_required", "manual_review_required")
        .when(a.isin(*continuous) | b.isin(*continuous), "numeric_continuous")
        .when(a.isin(*low) | b.isin(*low), "numeric_or_ordinal_review")
        .when(a.startswith("binary_") & b.startswith("binary_"), "binary")
        .otherwise("categorical")
    )


def _text_map(texts: dict[str, str], key: Column) -> Column:
    pairs = [x for k, v in texts.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def value_audit(
    a_tokens: DataFrame,
    b_tokens: DataFrame,
    groups: FeatureGroups = FeatureGroups(),
    names: tuple[str, str] = ("a", "b"),
    sample: int = 12,
) -> DataFrame:
    """Audit of every shared feature of two sources: counts, types, status, plan and review reasons."""

    keys = ["side", "feature"]
    texts = signatures(sides(a_tokens, b_tokens), keys)
    samples = first_values(
        texts.filter("signature is not null").select(*keys, "signature"), keys, F.col("signature"), "signature", sample
    )
    joined = coarse_types(texts, keys).join(samples, keys, "left")
    joined = joined.withColumn("values", F.coalesce("values", F.array().cast("array<string>")))
    both = by_side(joined, [c for c in joined.columns if c not in keys])
    rep_a, rep_b = F.col("representation_a"), F.col("representation_b")
    status = consistency(rep_a, rep_b)
    action = consistency_action(status)
    kind = modelling_type(rep_a, rep_b, action)
    why = F.concat(
        F.transform("warnings_a", lambda w: F.concat(F.lit(f"dataset_{names[0]}:"), w)),
        F.transform("warnings_b", lambda w: F.concat(F.lit(f"dataset_{names[1]}:"), w)),
        reasons(
            (
                status.isin(*MISMATCHES),
                F.concat(F.lit("cross_dataset_representation_mismatch:"), rep_a, F.lit("_vs_"), rep_b),
            ),
            (
                F.col("feature").isin(*groups.spreadsheet_risk) & (rep_b == "interval_text_bins"),
                PRE_BINNED_REASON.format(a=names[0], b=names[1]),
            ),
        ),
    )
    return both.select(
        "feature",
        *[f"{c}_{s}" for c in ("dtype", "non_null_count", "missing_count", "unique_count") for s in "ab"],
        "representation_a",
        "representation_b",
        F.col("values_a").alias("unique_values_sample_a"),
        F.col("values_b").alias("unique_values_sample_b"),
        status.alias("consistency_status"),
        action.alias("recommended_action"),
        kind.alias("recommended_modeling_type"),
        _text_map(TYPE_NOTES, kind).alias("type_plan_notes"),
        F.when(F.size(why) > 0, "yes").otherwise("no").alias("manual_review_required"),
        why.alias("manual_review_reasons"),
    )


def priority(feature: Column, groups: FeatureGroups) -> Column:
    return (
        F.when(feature.isin(*groups.low_risk_binary, *groups.mapped_binary), "binary_or_categorical_mismatch")
        .when(feature.isin(*groups.stage_like), "ordinal_or_stage_like")
        .when(feature.isin(*groups.interval_risk), "interval_or_numeric_mismatch")
        .otherwise("other")
    )


def representation_audit(
    a_tokens: DataFrame, b_tokens: DataFrame, groups: FeatureGroups = FeatureGroups(), sample: int = 10
) -> DataFrame:
    """Strict audit with first-seen examples; both token tables carry `first_row`."""

    keys = ["side", "feature"]
    tokens_ = normalised(sides(a_tokens, b_tokens), keys)
    found = strict_types(tokens_, keys).join(examples(tokens_, keys, sample), keys, "left")
    empty = F.array().cast("array<string>")
    found = found.withColumns({c: F.coalesce(F.col(c), empty) for c in ("unique_examples", "interval_examples")})
    wide = by_side(found, ["dtype", "representation", "unique_examples", "excel_like_tokens", "interval_examples"])
    filled = wide.withColumnsRenamed(
        {f"{old}_{s}": f"{new}_{s}" for old, new in (("dtype", "dtype_style"), ("representation", "representation_type")) for s in "ab"}
    )
    lists = ("unique_examples_a", "unique_examples_b", "excel_like_tokens_b", "interval_examples_b")
    feature = F.col("feature")
    notes = reasons(
        (F.size("excel_like_tokens_b") > 0, "excel_like_tokens_detected"),
        (F.size("interval_examples_b") > 0, "interval_style_values_detected"),
        (feature.isin(*groups.spreadsheet_risk), "high_priority_excel_investigation"),
        (feature.isin(*groups.interval_risk), "high_priority_interval_investigation"),
    )
    return filled.select(
        feature.alias("feature_name"),
        priority(feature, groups).alias("priority_group"),
        "dtype_style_a",
        "dtype_style_b",
        "representation_type_a",
        "representation_type_b",
        *lists,
        F.array_join(notes, "; ").alias("notes"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """Type counts and feature lists of a strict audit: (item, detail, value)."""
    types = audit.groupBy(F.col("representation_type_b").alias("detail")).agg(F.count(F.lit(1)).alias("value"))
    groups = audit.groupBy(F.col("priority_group").alias("detail")).agg(F.count(F.lit(1)).alias("value"))
    corrupt = audit.filter(F.col("representation_type_b") == "excel_like_corrupted_token").select(
        F.col("feature_name").alias("detail"), F.lit(1).cast("long").alias("value")
    )
    return (
        types.select(F.lit("representation_type").alias("item"), "detail", "value")
        .unionByName(groups.select(F.lit("priority_group").alias("item"), "detail", "value"))
        .unionByName(corrupt.select(F.lit("excel_like_corruption").alias("item"), "detail", "value"))
    )


BIN_CODE_ACTION = "convert_interval_to_ordered_bin_code"


def propose_rules(
    audit: DataFrame, groups: FeatureGroups = FeatureGroups(), names: tuple[str, str] = ("a", "b")
) -> DataFrame:
    """Harmonisation rule per feature; the first matching case wins."""
    f, a, b = F.col("feature_name"), F.col("representation_type_a"), F.col("representation_type_b")
    note = {k: v.format(a=names[0], b=names[1]) for k, v in RULE_NOTES.items()}
    binary_pair = (a == "binary_text") & (b == "binary_numeric")
    corrupted = b == "excel_like_corrupted_token"
    unsafe = "not_safe_for_cross_dataset_validation"
    conditional = "conditional_after_mapping_confirmation"

    def rule(action: str, confidence: str, review: str, status: str, text: str | None) -> Column:
        return F.struct(
            F.lit(action).alias("proposed_action"),
            F.lit(confidence).alias("confidence_level"),
            F.lit(review).alias("manual_review_required"),
            F.lit(status).alias("cross_dataset_validation_status"),
            F.lit(text).cast("string").alias("_note"),
        )

    low_risk = f.isin(*groups.low_risk_binary) & binary_pair
    mapped = f.isin(*groups.mapped_binary) & binary_pair
    chosen = (
        F.when(low_risk, rule("keep_as_binary_and_map", "medium", "yes", conditional, note["low_risk_binary"]))
        .when(mapped, rule("keep_as_binary_and_map", "medium", "yes", conditional, note["mapped_binary"]))
        .when(
            f.isin(*groups.repairable_spreadsheet) & corrupted,
            rule(
                "repair_excel_like_token_then_convert_to_ordered_bin_code",
                "medium",
                "yes",
                unsafe,
                note["repairable_spreadsheet"],
            ),
        )
        .when(f.isin(*groups.stage_like) & corrupted, rule("unresolved", "low", "yes", unsafe, note["stage_like"]))
        .when(
            f.isin(*groups.interval_risk) & (b == "interval_text"),
            rule(BIN_CODE_ACTION, "high", "no", "repaired_candidate_only_not_cross_dataset_safe", note["interval"]),
        )
        .otherwise(rule("unresolved", "low", "yes", unsafe, None))
    )
    ruled = audit.select(f, a, b, chosen.alias("_rule")).select(f, a, b, "_rule.*")
    notes = F.concat_ws(
        " ",
        F.col("_note"),
        F.when(f.isin(*groups.spreadsheet_risk), note["spreadsheet_suffix"]),
        F.when(
            f.isin(*groups.interval_risk) & (F.col("proposed_action") != BIN_CODE_ACTION), note["interval_suffix"]
        ),
    )
    return ruled.withColumn("notes", notes).drop("_note")


def safe_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(
        (F.col("proposed_action") == BIN_CODE_ACTION)
        & (F.col("confidence_level") == "high")
        & (F.col("manual_review_required") == "no")
    )


def review_rules(rules: DataFrame) -> DataFrame:
    return rules.join(safe_rules(rules).select("feature_name"), "feature_name", "left_anti")


def bin_codes(distinct: DataFrame) -> DataFrame:
    """Order-preserving code of every observed interval token, from 0 per feature.

    The window runs over the distinct tokens of a feature, never over its rows.
    Gaps between observed bins are closed; bins with equal bounds share a code.
    """
    parsed = (
        distinct.filter("raw is not null")
        .groupBy("feature", token(F.col("raw")).alias("token"))
        .agg(F.sum("row_count").alias("row_count"))
        .withColumn("bounds", interval(F.col("token")))
    )
    place = Window.partitionBy("feature").orderBy(F.asc_nulls_last("bounds.lower"), F.asc_nulls_last("bounds.upper"))
    return parsed.select(
        "feature",
        "token",
        "row_count",
        "bounds.kind",
        "bounds.lower",
        "bounds.upper",
        "bounds.canonical",
        F.when(F.col("bounds").isNotNull(), F.dense_rank().over(place) - 1).alias("code"),
    )


#: Codes up to which they are sent to all tasks.
SENT_CODES = 100_000


def apply_repairs(df: DataFrame, row_key: str, features: Sequence[str], codes: DataFrame, sent: int = SENT_CODES) -> DataFrame:
    """Replace the tokens of the chosen features by their bin code.

    The codes are counted: up to `sent` they go to all tasks and the table is not moved. More are joined once for all
    features together, with both sides spread over salts, as few bins may hold most rows; the codes of a row meet again by
    `row_key`, which is unique. A token without a code raises, however many bins there are.
    """
    listed = codes.filter(F.col("feature").isin(*features)).select("feature", "token", F.col("code").cast("int").alias("_code"))
    unparsed = listed.filter("_code IS NULL").orderBy("feature", "token").limit(10).collect()
    if unparsed:
        raise ValueError(f"Unexpected interval tokens during repair: {[(r['feature'], r['token']) for r in unparsed]}")

    def checked(name: Column, value: Column) -> Column:
        unknown = F.raise_error(F.concat(F.lit("Unexpected interval token of "), name, F.lit(": "), value)).cast("int")
        return F.when(value.isNotNull(), F.coalesce(F.col("_code"), unknown))

    if listed.count() <= sent:
        out = df
        for f in features:
            lookup = F.broadcast(listed.filter(F.col("feature") == f).select(F.col("token").alias("_token"), "_code"))
            out = out.withColumn("_token", token(F.col(f))).join(lookup, "_token", "left")
            out = out.withColumn(f, checked(F.lit(f), F.col("_token"))).drop("_token", "_code")
        return out.select(*df.columns)
    salts = shuffle_partitions(df.sparkSession)
    cells = df.select(row_key, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), token(F.col(f)).alias("token")) for f in features])))
    cells = cells.where("token IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int"))
    spread = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = cells.join(spread, ["feature", "token", "_salt"], "left").withColumn("_code", checked(F.col("feature"), F.col("token")))
    wide = found.groupBy(row_key).agg(*[F.max(F.when(F.col("feature") == f, F.col("_code"))).alias(f) for f in features])
    return df.drop(*features).join(wide, row_key, "left").select(*df.columns)


def repair_report(rules: DataFrame, codes: DataFrame) -> DataFrame:
    """One row per original spelling and per canonical spelling of every repaired bin, one row per skipped feature."""
    spellings = codes.select(
        F.col("feature").alias("feature_name"),
        F.explode(F.array_distinct(F.array("token", "canonical"))).alias("original_value"),
        F.col("code").cast("string").alias("repaired_value"),
    ).distinct()
    done = (
        safe_rules(rules)
        .join(spellings, "feature_name")
        .select(
            "feature_name",
            F.lit("yes").alias("repair_applied"),
            F.lit("ordered_bin_code").alias("repair_type"),
            "original_value",
            "repaired_value",
            "cross_dataset_validation_status",
            "notes",
        )
    )
    skipped = review_rules(rules).select(
        "feature_name",
        F.lit("no").alias("repair_applied"),
        F.lit("none").alias("repair_type"),
        F.lit("").alias("original_value"),
        F.lit("").alias("repaired_value"),
        "cross_dataset_validation_status",
        "notes",
    )
    return done.unionByName(skipped)


def unresolved_report(rules: DataFrame) -> DataFrame:
    return review_rules(rules).withColumnRenamed("notes", "reason")


def direction_note(feature: Column, groups: FeatureGroups, b_name: str = "b") -> Column:
    return (
        F.when(feature.isin(*groups.low_risk_binary), DIRECTION_NOTES["low_risk_binary"].format(b=b_name))
        .when(feature.isin(*groups.mapped_binary), DIRECTION_NOTES["mapped_binary"].format(b=b_name))
        .otherwise(DIRECTION_NOTES["other"])
    )


def value_key(raw: Column, numeric: Column, signature_text: Column) -> Column:
    """Report key of a cell: whole numbers without decimals, `<NA>` for missing."""
    whole = numeric & signature_text.rlike(r"^-?\d+$")
    return F.when(raw.isNull(), "<NA>").when(whole, signature_text).otherwise(F.trim(raw))


def direction_counts(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, target, value, rows) of the two-valued features, one pass."""
    cells = long_cells(df.withColumn("_t", F.col(target)), features, "_t")
    counts = cells.groupBy("feature", "is_numeric", F.col("row").alias("target"), "raw").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    value = value_key(F.col("raw"), F.col("is_numeric"), cell_signature())
    return counts.groupBy("feature", "target", value.alias("value")).agg(F.sum("row_count").alias("row_count"))


def direction_long(a: DataFrame, b: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(side, feature, target, value, row_count) of both sides; any number of values."""
    one = direction_counts(a, features, target).withColumn("side", F.lit("a"))
    return one.unionByName(direction_counts(b, features, target).withColumn("side", F.lit("b")))


def direction_audit(
    a: DataFrame,
    b: DataFrame,
    features: Sequence[str],
    target: str,
    row_key: str,
    groups: FeatureGroups = FeatureGroups(),
    names: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """Types, values, counts and per-class counts of two-valued features; every row asks for review.

    All values are listed. For features with very many values `direction_long` gives the same counts as rows.
    """

    keys = ["side", "feature"]

    def tagged(make) -> DataFrame:
        return make(a).withColumn("side", F.lit("a")).unionByName(make(b).withColumn("side", F.lit("b")))

    tokens_ = normalised(tagged(lambda df: tokens(long_cells(df, features, row_key), row_key=True)), keys)
    seen = tokens_.filter("token is not null").groupBy(*keys, "token").agg(F.min("first_row").alias("first_row"))
    seen = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first_row", "token"))).alias("seen"))
    values = seen.select(*keys, F.transform("seen", lambda s: s["token"]).alias("unique_values"))
    counts = direction_long(a, b, features, target)
    entry = F.struct("value", "row_count")
    per_class = (
        counts.groupBy(*keys, "target")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    )
    nested = per_class.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("target").cast("string"), F.col("m")))).alias("target_breakdown")
    )
    totals = (
        counts.groupBy(*keys, "value")
        .agg(F.sum("row_count").alias("row_count"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("value_counts"))
    )
    joined = strict_types(tokens_, keys).withColumnRenamed("representation", "representation_type")
    for part in (values, totals, nested):
        joined = joined.join(part, keys, "left")
    both = by_side(
        joined, ["representation_type", "dtype", "unique_values", "value_counts", "target_breakdown"]
    )
    feature = F.col("feature")
    return both.select(
        feature.alias("feature_name"),
        *[c for c in both.columns if c != "feature"],
        F.lit("yes").alias("manual_review_required"),
        direction_note(feature, groups, names[1]).alias("notes"),
    )


def confirmation_template(audit: DataFrame) -> DataFrame:
    """The audit with empty answer columns for a human reviewer."""
    return audit.withColumns(
        {
            "confirmed_b_meaning_for_0": F.lit(""),
            "confirmed_b_meaning_for_1": F.lit(""),
            "confirmed_mapping_to_a": F.lit(""),
            "safe_to_apply_binary_harmonization": F.lit("pending_review"),
        }
    )
