import pytest
from pyspark.sql import functions as F

from riskloom.fixed import LABELS_SOURCE_A, LABELS_SOURCE_B
from riskloom.operators import align, audit, clean, profile
from riskloom.operators.contracts import ContractError
from riskloom.plans.harmonise import harmonise

A = [(i, float(20 + i), float(i % 6), "yes" if i % 2 else "no", float(4 + i % 13), "ckd\t" if i == 0 else ("ckd" if i % 2 else "notckd")) for i in range(40)]
POT = ["< 7.31", "7.31 - 11.72", "38.18 - 42.59", "≥ 42.59"]
AGE = ["< 12", "20-Dec", "20 - 27", "≥ 74"]
AL = ["< 0", "1-Jan", "≥ 4", "2-Feb"]
B = [(i, AGE[i % 4], AL[i % 4], i % 2, POT[i % 4], "ckd" if i % 2 else "notckd") for i in range(24)]
NAMES = ["age", "al", "dm", "pot"]


def sources(spark):
    a = spark.createDataFrame(A, "row long, age double, al double, dm string, pot double, class string")
    b = spark.createDataFrame(B, "row long, age string, al string, dm int, pot string, class string")
    return a, b


def mapping(spark, **changes):
    rows = [(c, c, c, "yes", "yes", changes.get("keep", "yes"), "", changes.get("review", "no")) for c in NAMES]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in align.MAPPING_COLUMNS))


def test_harmonise_end_to_end(spark):
    out = harmonise(*sources(spark), mapping(spark), "row", "class", LABELS_SOURCE_A, LABELS_SOURCE_B)
    types = {r["feature_name"]: r["representation_type_b"] for r in out.representation_audit.collect()}
    assert types == {
        "age": "excel_like_corrupted_token",
        "al": "excel_like_corrupted_token",
        "dm": "binary_numeric",
        "pot": "interval_text",
    }
    rules = {r["feature_name"]: (r["proposed_action"], r["confidence_level"]) for r in out.rules.collect()}
    assert rules["age"] == ("repair_excel_like_token_then_convert_to_ordered_bin_code", "medium")
    assert rules["al"] == ("unresolved", "low") and rules["dm"] == ("keep_as_binary_and_map", "medium")
    assert rules["pot"] == ("convert_interval_to_ordered_bin_code", "high")
    repaired = {r["row"]: (r["pot"], r["age"]) for r in out.repaired_b.collect()}
    assert all(repaired[i] == (i % 4, AGE[i % 4]) for i in range(24))
    report = {(r["feature_name"], r["original_value"]): r["repaired_value"] for r in out.repair_report.collect()}
    assert report[("pot", "38.18 - 42.59")] == "2" and report[("age", "")] == ""
    assert {r["feature_name"] for r in out.unresolved.collect()} == {"age", "al", "dm"}
    coarse = {r["feature"]: (r["representation_b"], r["consistency_status"]) for r in out.value_audit.collect()}
    assert coarse["age"] == ("categorical_text", "representation_mismatch")
    assert coarse["dm"] == ("binary_numeric", "binary_encoding_mismatch")
    direction = {r["feature_name"]: r for r in out.direction_audit.collect()}
    assert direction["dm"]["value_counts_b"] == {"0": 12, "1": 12}
    assert direction["dm"]["target_breakdown_b"]["1"] == {"1": 12}


def test_open_review_blocks_the_mapping(spark):
    with pytest.raises(ContractError):
        align.confirmed(mapping(spark, review="yes"))
    with pytest.raises(ValueError):
        align.confirmed(mapping(spark, keep="no"))


def test_candidates(spark):
    left = align.column_catalogue(spark, ["age", "bp", "rbc"])
    right = align.column_catalogue(spark, ["age", "bp (Diastolic)", "grf"])
    rows = {r["unified_name"]: r for r in align.candidates(left, right).collect()}
    assert set(rows) == {"age", "blood_pressure_candidate", "rbc", "grf"}
    assert rows["grf"]["source_a_column"] == "" and rows["age"]["manual_review_required"] == "yes"


def test_labels_are_exact(spark):
    df = spark.createDataFrame([("ckd",), ("CKD",), (None,)], "c string")
    with pytest.raises(ContractError, match="CKD"):
        clean.encode_labels(df, "c", LABELS_SOURCE_A)
    assert clean.unresolved_labels(df, "c", LABELS_SOURCE_A).count() == 2


def test_coercion_is_all_or_nothing(spark):
    df = spark.createDataFrame([(" 1 ", "1", " "), ("2.5", "x", None)], "a string, b string, c string")
    out = clean.minimal_clean(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert [r["a"] for r in out.orderBy("a").collect()] == [1.0, 2.5]


@pytest.mark.parametrize("bins", [5, 2500])
def test_a_bad_token_stops_the_repair_for_any_number_of_bins(spark, bins):
    good = spark.createDataFrame([(i, f"{i} - {i + 1}") for i in range(bins)] + [(bins, None)], "row long, pot string")
    codes = audit.bin_codes(audit.tokens(audit.long_cells(good, ["pot"])))
    repaired = {r["row"]: r["pot"] for r in audit.apply_repairs(good, "row", ["pot"], codes).collect()}
    assert repaired == {**{i: i for i in range(bins)}, bins: None}
    bad = good.withColumn("pot", F.when(F.col("row") == 2, "odd").otherwise(F.col("pot")))
    with pytest.raises(ValueError, match="odd"):
        audit.apply_repairs(bad, "row", ["pot"], audit.bin_codes(audit.tokens(audit.long_cells(bad, ["pot"]))))
    with pytest.raises(Exception, match="odd"):
        audit.apply_repairs(bad, "row", ["pot"], codes).collect()


def test_all_values_of_a_direction_audit(spark):
    a = spark.createDataFrame([(i, str(i % 12), i % 2) for i in range(48)], "row long, x string, target int")
    found = audit.direction_audit(a, a, ["x"], "target", "row").first()
    assert len(found["unique_values_a"]) == 12 and found["value_counts_a"]["11"] == 4
    assert found["target_breakdown_a"]["1"]["11"] == 4 and "11" not in found["target_breakdown_a"]["0"]


def test_all_missing_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "row long, x string")
    distinct = audit.tokens(audit.long_cells(df, ["x"], "row"), row_key=True)
    assert audit.strict_types(audit.normalised(distinct)).first()["representation"] == "unresolved"
    assert audit.coarse_types(audit.signatures(distinct, ["feature"])).first()["representation"] == "all_missing"


def test_duplicates_keep_missing_apart(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    assert profile.duplicate_rows(df).first()["duplicate_row_count"] == 1
    assert profile.missingness(df).filter(F.col("column") == "y").first()["missing_count"] == 2
    assert "missing_ratio" in profile.profile_document(df, "x", "d", "name").first()["document"]


@pytest.mark.parametrize("sent", [0, 100])
def test_repairs_of_two_features_by_either_way(spark, sent):
    rows = [(i, f"{i % 3 * 10} - {i % 3 * 10 + 10}" if i % 5 else None, "< 5" if i % 2 else ">= 5", "x") for i in range(40)]
    df = spark.createDataFrame(rows, "row long, pot string, sod string, other string")
    codes = audit.bin_codes(audit.tokens(audit.long_cells(df, ["pot", "sod"])))
    out = audit.apply_repairs(df, "row", ["pot", "sod"], codes, sent)
    assert out.columns == df.columns
    found = {r["row"]: (r["pot"], r["sod"], r["other"]) for r in out.collect()}
    assert found == {i: (i % 3 if i % 5 else None, 0 if i % 2 else 1, "x") for i in range(40)}
    odd = df.union(spark.createDataFrame([(99, "50 - 60", "< 5", "y")], df.schema))
    with pytest.raises(Exception, match="Unexpected interval token"):
        audit.apply_repairs(odd, "row", ["pot", "sod"], codes, sent).collect()
