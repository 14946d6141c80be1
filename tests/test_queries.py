import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_module  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "label_normalise", "stratified_split", "manifest_build", "resolve_references", "dataset_fingerprint", "classification_report",
    "roc_auc", "epoch_tracking", "token_matches", "token_dedupe", "hybrid_vote_report", "bin_geometry", "nearest_neighbours",
    "eps_clusters", "chart_values", "templated_answers",
]


def test_registry_is_consistent():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert set(SAMPLE) <= set(sql)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    from check_oracle import compare, connect

    ok, note = compare(entry_module.queries()[name](spark, SF), connect(SF), entry_module.oracle_sql()[name])
    assert ok, note


def test_flagship(spark):
    rows = entry_module.entry(spark).collect()
    assert {"accuracy", "macro avg", "weighted avg"} <= {r["label"] for r in rows}
