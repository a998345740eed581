"""Registered queries against their SQL oracles (DuckDB) on the smallest driver tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
FAST = ["table_shape", "drop_unlabelled", "class_balance", "null_profile", "value_counts", "prep_stats",
        "prepared_table", "stratified_split", "stratified_folds", "random_undersample", "partial_undersample",
        "rus_naive_bayes_cell", "knn_join_euclidean", "smote", "adasyn", "near_miss", "knn_classifier_distance", "naive_bayes_grid_scores",
        "naive_bayes_grid_cell", "phase2_naive_bayes_cells", "extra_trees_splits", "decision_tree_splits", "random_forest_splits",
        "linear_svm_weights", "survey_csv_types", "survey_csv_inferred"]


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF):
        pytest.skip("driver tables not present")
    return duck(SF)


def test_every_query_has_docstring_and_oracle_names():
    qs, os_ = entry.queries(), entry.oracle_sql()
    assert set(os_) <= set(qs)
    assert all(fn.__doc__ for fn in qs.values())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, msg


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].model == "B1_RUS + C7_NaiveBayes"
