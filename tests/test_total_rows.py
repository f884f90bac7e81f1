"""Rows that begin with "Total By" are never items, whatever follows."""

from branchlens.sources import reports

LINES = ["Store - A", "TABLE", "HOT", "TEA", "mint", "Total By Season:", "Total  by Department: TABLE",
         "TAKE AWAY", "COLD", "ICE", "cola", "End"]
ITEMS = ("mint", "cola")


def test_total_prefix(spark):
    rows = [("f", i, d, *(["1", "9", "4", "5"] if d in ITEMS or d.lower().startswith("total") else [None] * 4))
            for i, d in enumerate(LINES, 1)]
    lines = spark.createDataFrame(rows, "file string, line_no int, desc string, qty string, price string, "
                                        "cost string, profit string")
    parsed = reports.parse_item_report(lines)
    got = {r["product"]: (r["Branch"], r["Department"], r["Category"], r["Division"])
           for r in reports.report_facts(parsed).collect()}
    assert got == {"mint": ("A", "TABLE", "HOT", "TEA"), "cola": ("A", "TAKE AWAY", "COLD", "ICE")}
    assert {r["total_scope"] for r in reports.report_totals(parsed).collect()} == {"Season", "Department"}
