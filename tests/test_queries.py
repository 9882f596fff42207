"""Registered queries against their DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "id_map_add_ids", "filter_interactions", "sparse_features", "time_range_split", "last_n_split", "random_split", "popular_sum_weight", "popular_in_category_rotate", "item_knn_tfidf", "rank_cosine",
    "classification_metrics", "ranking_metrics", "auc_metrics", "beyond_accuracy_metrics", "debiased_recall", "cross_validation", "two_stage_train", "masked_session_lists", "op1_topk", "op2_license_scan",
    "op3_line_dedup", "op5_decontaminate",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{SF_DIR}/{file}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):  # noqa: ANN001
    known, sql = entry.queries(), entry.oracle_sql()
    if name not in known:
        pytest.skip("its subpackage is absent")
    got, want = known[name](spark, SF_DIR).toPandas(), duck.execute(sql[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda t: t[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want)) and len(got)


def test_entry(spark):  # noqa: ANN001
    assert entry.entry(spark).columns == ["user_id", "item_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
