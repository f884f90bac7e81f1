"""Physical plans: pruning, pushdown, and no cartesian / nested-loop joins."""

import contextlib
import io

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
CHEAP = ["q_margin_branch_category", "q_margin_heatmap", "q_branch_department_features", "q_product_table",
         "q_lag_features", "q_ols_forecast", "q_month_corr_matrix", "q_group_share_long", "q_top_products",
         "q_insights", "q_scenarios", "q_hierarchy_explicit", "q_paged_report_long"]


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", CHEAP)
def test_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_scan_pruned_and_pushed(spark):
    p = plan(E.queries()["q_margin_branch_category"](spark, SF))
    li = [ln for ln in p.splitlines() if ln.startswith("ReadSchema: struct<l_orderkey")][0]
    assert "l_shipdate" not in li and "l_tax" not in li and "l_comment" not in li
    assert "EqualTo(l_returnflag" in p
    od = [ln for ln in p.splitlines() if ln.startswith("ReadSchema: struct<o_orderkey")][0]
    assert "o_orderdate" not in od          # the margin query never needs the date
