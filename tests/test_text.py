import random

from pyspark.sql import functions as F

from riskloom.functions import text as X


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_number_text_prints_like_percent_g(spark):
    rng = random.Random(3)
    values = [10026.55, 100062.5, 999999.5, 0.00012345678, 5e-7, 123456789.5, 0.1, -2.5, -0.00001234565]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(200)]
    expected = [str(int(v)) if v.is_integer() else format(v, "g") for v in values]
    assert column(spark, values, "double", X.number_text) == expected


def test_exact_round_matches_printing(spark):
    values = [0.00625, 1.0005, 2.6745, 0.0625, 0.1875, 1234.00005]
    assert column(spark, values, "double", lambda v: X.exact_round(v, 4)) == [round(v, 4) for v in values]
    assert column(spark, [0.8125, 0.0625], "double", lambda v: X.exact_round(v, 3, half_up=True)) == [0.813, 0.063]


def test_cells_and_numbers(spark):
    assert column(spark, [" a\t", "\n", "", None, "b c"], "string", X.blank_to_null) == ["a", None, None, None, "b c"]
    texts = ["5", " 5.5 ", "1e3", "5f", "nan", "Infinity", "", "-.5", "1 2", None]
    assert column(spark, texts, "string", X.number) == [5.0, 5.5, 1000.0, None, None, None, None, -0.5, None, None]
    assert column(spark, ["bp (Diastolic)", " A--b_"], "string", X.normalized_name) == ["bp_diastolic", "a_b"]


def test_intervals(spark):
    rows = column(spark, ["≥  74", "12 -  20.50", "< 0", "<= 3", "20-Dec", "> 4"], "string", X.interval)
    assert [r and (r["kind"], r["canonical"]) for r in rows] == [
        ("ge", ">= 74"), ("range", "12 - 20.5"), ("lt", "< 0"), None, None, None,
    ]
    assert rows[0]["upper"] == float("inf") and rows[2]["lower"] == float("-inf")


def test_date_and_interval_predicates_differ(spark):
    tokens = ["20-Dec", "4-Xyz", "3-sept", "<= 3", "1 - 2"]
    assert column(spark, tokens, "string", X.coarse_spreadsheet_date) == [True, False, True, False, False]
    assert column(spark, tokens, "string", X.strict_spreadsheet_date) == [True, True, False, False, False]
    assert column(spark, tokens, "string", X.coarse_interval) == [False, False, False, True, True]


def test_yes_no(spark):
    words = ["Yes", " y ", "poor", "NOTPRESENT", "0", "maybe", " ", None]
    assert column(spark, words, "string", X.yes_no) == ["yes", "yes", "yes", "no", "no", "maybe", None, None]
