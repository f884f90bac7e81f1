"""A sample of registered queries against their DuckDB oracle on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["q_margin_branch_category", "q_product_table", "q_lag_features", "q_ols_forecast",
         "q_hierarchy_implicit", "q_hierarchy_explicit", "q_group_share_long", "q_success_tiers_rule",
         "q_top_products", "q_scenarios"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    pdf = E.queries()[name](spark, SF).toPandas()
    odf = con.sql(E.oracle_sql()[name]).df()
    assert sorted(pdf.columns) == sorted(odf.columns)
    cols = sorted(pdf.columns)

    def rows(df):
        out = [tuple(_norm(r[c]) for c in cols) for r in df.astype(object).where(df.notna(), None).to_dict("records")]
        return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert rows(pdf) == rows(odf)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
