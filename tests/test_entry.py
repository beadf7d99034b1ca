import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "profile_missingness", "clean_minimal", "split_stratified", "metrics_by_model", "leakage_feature_screen",
    "bootstrap_replicates", "tests_delong", "audit_values", "score_research_contributions", "requests_scored",
    "monitor_latency_summary", "lifecycle_transition_audit", "requests_invalid_number", "model_scored_batch",
    "stream_model_scored", "model_boosting_cells", "model_chained_imputation", "model_weighted_ensemble", "tests_p_values",
    "stream_alarm_states", "file_documents",
)
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 2 and "auroc" in df.columns


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    message, good = compare(spark, connection, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good, message
