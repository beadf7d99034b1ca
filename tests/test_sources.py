import pytest

from riskloom.operators.contracts import ContractError, require_binary
from riskloom.plans.runlog import logged
from riskloom.sources import tables


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text', ["x", "y"]), (2, None, None)], "i int, t string, l array<string>")
    tables.write_csv(df, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c")).orderBy("i").collect()
    assert back[0]["t"] == 'a "quoted", text' and back[0]["l"] == '["x","y"]' and back[1]["t"] is None


def test_tagged_predictions(spark, tmp_path):
    for name in ("a", "b"):
        tables.write_csv(spark.createDataFrame([(1, 1, 0, 0.25)], tables.PREDICTION_SCHEMA), str(tmp_path / name))
    out = tables.read_tagged(spark, {n: str(tmp_path / n) for n in "ab"}, tables.PREDICTION_SCHEMA)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, 0.25, "a"), (1, 1, 0, 0.25, "b")]


def test_events_append_and_blank_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part.json").write_text('{"event_id": "1", "event_type": "approved"}\n\n')
    tables.append_events(spark.createDataFrame([("2", "promoted")], "event_id string, event_type string"), str(tmp_path / "log"))
    assert sorted(r["event_id"] for r in tables.read_events(spark, str(tmp_path / "log")).collect()) == ["1", "2"]


def test_reviewed_template_is_kept(spark, tmp_path):
    for value in (1, 2):
        tables.write_once(spark.createDataFrame([(value,)], "v int"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["v"] == 1


def test_latency_sink_has_twelve_columns(spark, tmp_path):
    samples = spark.createDataFrame([("r", "measured", 1, "t", 1.5, 200, True, 0.5, "l", "v", "s", None)], tables.LATENCY_SCHEMA)
    tables.write_samples(samples, str(tmp_path / "s"))
    assert tables.read_csv(spark, str(tmp_path / "s")).columns == samples.columns
    with pytest.raises(ContractError):
        tables.write_samples(samples.drop("error"), str(tmp_path / "x"))


def test_contracts(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "k int, y int")
    assert require_binary(df, "y") is df
    with pytest.raises(ContractError):
        require_binary(df, "k")
    with pytest.raises(ValueError):
        tables.load_dataset(df, None, "k", "y")
    assert tables.load_dataset(df.select("k"), df, "k", "y").count() == 2


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert logged(spark, path, "good", lambda: 3) == 3
    with pytest.raises(RuntimeError):
        logged(spark, path, "bad", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    rows = {(r["run_name"], r["status"], r["error_type"]) for r in spark.read.json(path).collect()}
    assert rows == {("good", "started", None), ("good", "success", None), ("bad", "started", None), ("bad", "failed", "RuntimeError")}
