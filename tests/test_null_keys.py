"""A null product or branch keeps its category, division and shares."""

from branchlens.operators import products

COLS = "branch string, product string, category string, division string, department string, " \
       "price double, cost double, profit double, qty double"
ROWS = [("a", "x", "c1", "d1", "TABLE", 10.0, 4.0, 6.0, 1.0),
        ("a", None, "c2", "d2", "TABLE", 30.0, 10.0, 20.0, 2.0),
        (None, "x", "c1", "d1", "TABLE", 5.0, 1.0, 4.0, 1.0)]


def test_null_product_keeps_its_modes(spark):
    got = {r["Product"]: (r["Category"], r["Division"]) for r in
           products.product_table(spark.createDataFrame(ROWS, COLS)).collect()}
    assert got == {"x": ("c1", "d1"), None: ("c2", "d2")}


def test_null_branch_keeps_its_share(spark):
    got = {(r["branch"], r["Product"]): (r["Category"], r["SalesShareInBranch"]) for r in
           products.branch_product_table(spark.createDataFrame(ROWS, COLS)).collect()}
    assert got == {("a", "x"): ("c1", 0.25), ("a", None): ("c2", 0.75), (None, "x"): ("c1", 1.0)}
