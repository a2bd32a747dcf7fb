"""A sample of registered queries against their SQL on the smallest tables (``tools/oracle_check.py`` runs all)."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "late_events", "validate_record", "ingest_dedup", "grid_carry", "grid_state", "feat_baseline", "paste_after_return", "flags", "session_digest",
    "signal_lanes", "avg_precision", "fpr_threshold", "psi", "drift_report", "session_search", "review_queue", "stratified_split", "ids_hash",
    "flag_iou", "calibrate_lookup", "rule_score", "top_reasons",
]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 110


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, name):
    from tools.oracle_check import compare, connect

    message, _ = compare(spark, connect(SF), queries()[name], oracle_sql()[name], SF)
    assert message == ""
