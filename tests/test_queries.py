"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest
from oracle import TESTDATA, compare, connect

SF_DIR = f"{TESTDATA}/sf0.001"
PICKED = [
    "g2_top_down", "g3_bottom_up", "g21_hot_path", "g22_hot_spots", "g24_self_time_spread", "g26_concentration",
    "d7_ranked_statements", "d9_database_tree", "d11_db_burned_in", "x5_density", "x6_skyline", "x7_event_at",
    "l6_limit_series", "t1_spans_from_logs", "t8_totals_from_logs", "t12_t13_issues", "q7_find_repeats_text",
    "q12_lint_columns", "g11_scoped_tree", "f1_filter_deep", "f8_find_in_documents", "r1_subtree_totals",
]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables not present")
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, name):
    from spanforge.plans import ORACLE, QUERIES

    assert compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLE[name], SF_DIR) is None


def test_every_query_has_sql():
    from spanforge.plans import ORACLE, QUERIES

    assert set(QUERIES) == set(ORACLE)
