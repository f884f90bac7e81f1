"""Report-cleaning queries: the hierarchical POS exports are written from the
items view with the faults of real exports (``write_item_report``), parsed back
chunk by chunk, and checked against the direct aggregate (A2, D1f-D7f, E1-E5,
K1-K3, C7, I18)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import r6, rm
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import files
from ..sources import reports as rp
from ..sources.tables import items, with_items
from .registry import register
from .sqlparts import R6


def parsed_item_report(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return rp.parse_item_report(rp.write_item_report(items(spark, sf_dir), faults=True, dense=dense))


# sections of the written reports, and the faults: February files have no branch
# total, March files an empty department, April files a stray zero line
_GROUP_COUNTS = """gc AS (
  SELECT COUNT(DISTINCT (branch, year, month)) AS n_files,
         COUNT(DISTINCT (branch, year, month)) FILTER (WHERE month = 2) AS n_feb,
         COUNT(DISTINCT (branch, year, month)) FILTER (WHERE month = 3) AS n_mar,
         COUNT(DISTINCT (branch, year, month)) FILTER (WHERE month = 4) AS n_apr,
         COUNT(DISTINCT (branch, year, month, department)) AS n_dep,
         COUNT(DISTINCT (branch, year, month, department, category)) AS n_cat,
         COUNT(DISTINCT (branch, year, month, department, category, division)) AS n_div,
         COUNT(DISTINCT (branch, year, month, department, category, division, product)) AS n_prod
  FROM items)"""


@register("q_hierarchy_implicit", with_items("""
SELECT branch AS Branch, department AS Department, category AS Category, division AS Division,
       COUNT(*) AS n_items, ROUND(SUM(qty), 4) AS Qty, ROUND(SUM(price), 4) AS Sales,
       ROUND(SUM(cost), 4) AS Cost, ROUND(SUM(profit), 4) AS Profit
FROM (SELECT branch, year, month, department, category, division, product,
             SUM(qty) AS qty, ROUND(SUM(cost), 4) + ROUND(SUM(profit), 4) AS price,
             ROUND(SUM(cost), 4) AS cost, ROUND(SUM(profit), 4) AS profit
      FROM items GROUP BY ALL)
GROUP BY ALL"""))
def q_hierarchy_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the Branch > Department > Category > Division item report per
    branch-month, parse it back (noise, footer, openings, closings, numbers,
    price repair) and aggregate the recovered item rows (E1-E5, D1f-D5f, K1, C7)."""
    f = rp.report_facts(parsed_item_report(spark, sf_dir))
    return (f.groupBy(*rp.LEVELS)
            .agg(F.count(F.lit(1)).alias("n_items"), rm(F.sum("qty")).alias("Qty"), rm(F.sum("price")).alias("Sales"),
                 rm(F.sum("cost")).alias("Cost"), rm(F.sum("profit")).alias("Profit")))


@register("q_rollup_reconcile", with_items("""
, t AS (
  SELECT 'Division' AS scope, month, SUM(profit) AS p FROM items
    GROUP BY branch, year, month, department, category, division
  UNION ALL SELECT 'Category', month, NULL FROM items GROUP BY branch, year, month, department, category
  UNION ALL SELECT 'Department', month, NULL FROM items GROUP BY branch, year, month, department
  UNION ALL SELECT 'Branch', month, NULL FROM items GROUP BY branch, year, month)
SELECT scope, CASE WHEN scope = 'Branch' AND month = 2 THEN 'computed only' ELSE 'both' END AS reason,
       COUNT(*) AS n_totals,
       CASE WHEN scope = 'Branch' AND month = 2 THEN CAST(NULL AS DOUBLE)
            ELSE ROUND(COALESCE(MAX(ABS(p - round_even(p, 0))), 0), 2) END AS max_abs_diff
FROM (SELECT scope, p, CASE WHEN scope = 'Branch' AND month = 2 THEN 2 ELSE 0 END AS month FROM t)
GROUP BY scope, month
UNION ALL SELECT 'Department', 'printed only', n_mar, CAST(NULL AS DOUBLE) FROM gc WHERE n_mar > 0""", _GROUP_COUNTS))
def q_rollup_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed ``Total By`` rows against a recomputed ``rollup`` of the parsed
    item rows per file, as a full outer join with a reason for totals of one
    side only (I18, F9, D6f): number of totals per scope and reason and the
    largest absolute profit difference (rounded to cents)."""
    parsed = parsed_item_report(spark, sf_dir)
    return rp.reconcile_totals(rp.report_totals(parsed), rp.report_facts(parsed)).groupBy("scope", "reason").agg(
        F.count(F.lit(1)).alias("n_totals"), F.round(F.max(F.abs(F.col("printed") - F.col("computed"))), 2).alias("max_abs_diff"))


@register("q_hierarchy_explicit", with_items("""
SELECT branch AS Branch, division AS Division, grp AS "Group", COUNT(*) AS n_items,
       ROUND(SUM(qty), 4) AS Qty, ROUND(SUM(amount), 4) AS TotalAmount
FROM (SELECT branch, year, division, grp, product, SUM(qty) AS qty, ROUND(SUM(price), 4) AS amount
      FROM items GROUP BY ALL)
GROUP BY ALL"""))
def q_hierarchy_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the explicit ``Branch: / Division: / Group:`` report per
    branch-year, parse it with the last-opening rule and aggregate the item
    rows (E2, E5, K3, D5f)."""
    lines = rp.write_group_report(items(spark, sf_dir), dense=False)
    parsed = rp.parse_group_report(lines)
    it = parsed.filter(~F.col("is_total") & ~F.col("is_open"))
    return (it.groupBy("Branch", "Division", "Group")
            .agg(F.count(F.lit(1)).alias("n_items"), rm(F.sum(rp.to_num(F.col("qty")))).alias("Qty"),
                 rm(F.sum(rp.to_num(F.col("amount")))).alias("TotalAmount")))


def _report_monthly(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    it = items(spark, sf_dir)
    return rp.write_monthly_report(it.groupBy("branch", "year", "month").agg(F.sum("price").alias("sales")), dense)


@register("q_paged_report_long", with_items("""
, m AS (SELECT branch, year, month, ROUND(SUM(price), 4) AS s FROM items GROUP BY ALL)
, g AS (SELECT b.branch, b.year, CAST(mm.month AS INTEGER) AS month
        FROM (SELECT DISTINCT branch, year FROM m) b, range(1, 13) mm(month))
SELECT g.branch, g.year, g.month, COALESCE(m.s, 0) AS sales
FROM g LEFT JOIN m ON g.branch = m.branch AND g.year = m.year AND g.month = m.month"""))
def q_paged_report_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the paged monthly report (one or two column blocks per year, shifted
    header, year on the first row of a page, Total rows) and parse it back to
    long (branch, year, month, sales) (A10, A4-A9, D8f, J6, K2)."""
    long = rp.parse_monthly_report(_report_monthly(spark, sf_dir)).filter(F.col("month") > 0)
    return long.select("branch", "year", "month", rm("sales").alias("sales"))


@register("q_year_total_check", with_items("""
, t AS (SELECT branch, year, SUM(s) AS t FROM (
          SELECT branch, year, month, ROUND(SUM(price), 4) AS s FROM items GROUP BY ALL) GROUP BY branch, year)
SELECT year, COUNT(*) AS n_branches, ROUND(MAX(ABS(t - round_even(t, 0))), 2) AS max_abs_diff FROM t GROUP BY year"""))
def q_year_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed ``Total By Year`` (without decimals) against the sum of the
    parsed months per branch-year (I18 on the monthly report)."""
    long = rp.parse_monthly_report(_report_monthly(spark, sf_dir))
    s = long.groupBy("branch", "year").agg(
        F.sum(F.when(F.col("month") > 0, F.col("sales"))).alias("months"),
        F.sum(F.when(F.col("month") == 0, F.col("sales"))).alias("printed"))
    return s.groupBy("year").agg(F.count(F.lit(1)).alias("n_branches"),
                                 F.round(F.max(F.abs(F.col("months") - F.col("printed"))), 2).alias("max_abs_diff"))


@register("q_null_profile", with_items(f"""
, t AS (SELECT *, 2 * n_files - n_feb + 2 * (n_dep + n_mar + n_cat + n_div) + n_prod + n_apr AS n_lines FROM gc)
, z AS (
  SELECT 'desc' AS "column", 0 AS n_null FROM t UNION ALL
  SELECT 'qty', n_files + n_dep + n_mar + n_cat + n_div FROM t UNION ALL
  SELECT 'Branch', n_apr FROM t UNION ALL
  SELECT 'Department', n_apr + 2 * n_files - n_feb FROM t UNION ALL
  SELECT 'Category', n_apr + 2 * n_files - n_feb + 2 * (n_dep + n_mar) FROM t UNION ALL
  SELECT 'Division', n_apr + 2 * n_files - n_feb + 2 * (n_dep + n_mar + n_cat) FROM t)
SELECT "column", n_null, {R6("n_null / (SELECT n_lines FROM t)")} AS pct_null,
       n_null / (SELECT n_lines FROM t) >= 0.9 AS sparse FROM z""", _GROUP_COUNTS))
def q_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null count / percent per column of the parsed report lines after noise
    and footer removal, with the >= 90 % sparse flag (G13, C3, E3)."""
    parsed = parsed_item_report(spark, sf_dir)
    prof = rp.null_profile(parsed, ["desc", "qty", *rp.LEVELS])
    return prof.select("column", F.col("n_null").cast("bigint").alias("n_null"),
                       r6("pct_null").alias("pct_null"), "sparse")


@register("q_totals_items_split", with_items("""
SELECT scope, n FROM (
  SELECT 'Division' AS scope, n_div AS n FROM gc UNION ALL SELECT 'Category', n_cat FROM gc UNION ALL
  SELECT 'Department', n_dep + n_mar FROM gc UNION ALL SELECT 'Branch', n_files - n_feb FROM gc UNION ALL
  SELECT 'items', n_prod + n_apr FROM gc UNION ALL SELECT 'leaked_totals', n_apr FROM gc)""", _GROUP_COUNTS))
def q_totals_items_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass splits report rows into totals per scope and items; the leak
    check counts item rows still containing 'Total by' (D5f, D6f, D7f)."""
    parsed = parsed_item_report(spark, sf_dir)
    rows = parsed.filter(~F.col("is_open"))
    scope = F.when(F.col("is_total"), F.col("total_scope")).otherwise(F.lit("items"))
    leaked = ~F.col("is_total") & F.lower(F.col("desc")).contains("total by")
    # a row a scope, kept so that both parts of the result come from the one pass
    counts = cut_lineage(rows.groupBy(scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.count_if(leaked).alias("leaked")))
    leak = counts.agg(F.lit("leaked_totals").alias("scope"), F.coalesce(F.sum("leaked"), F.lit(0)).alias("n"))
    return counts.select("scope", "n").unionByName(leak)


@register("q_price_overflow", with_items(f"""
, p AS (
  SELECT 'item' AS kind, SUM(price) AS p FROM items
    GROUP BY branch, year, month, department, category, division, product
  UNION ALL SELECT 'total', SUM(price) FROM items GROUP BY branch, year, month, department, category, division
  UNION ALL SELECT 'total', SUM(price) FROM items GROUP BY branch, year, month, department, category
  UNION ALL SELECT 'total', SUM(price) FROM items GROUP BY branch, year, month, department
  UNION ALL SELECT 'total', SUM(price) FROM items WHERE month <> 2 GROUP BY branch, year, month)
SELECT kind, CAST(greatest(floor(log10(abs(p))) + 1 - {rp.PRICE_DIGITS}, 0) AS INTEGER) AS lost_digits, COUNT(*) AS n
FROM p GROUP BY ALL
UNION ALL SELECT 'item', NULL, n_apr FROM gc WHERE n_apr > 0
UNION ALL SELECT 'total', NULL, n_mar FROM gc WHERE n_mar > 0""", _GROUP_COUNTS))
def q_price_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits lost by the printed Total Price against cost + profit, per
    line kind (I19, X6); null where either is zero."""
    return rp.price_overflow(parsed_item_report(spark, sf_dir)).select(
        "kind", F.col("lost_digits"), F.col("n"))


@register("q_context_rows", with_items(f"""
, p AS (SELECT DISTINCT branch, year, month, department, category, division, product FROM items)
, l AS (
  SELECT DISTINCT branch, year, month, 0 AS r0, '' AS dep, n AS r2, '' AS cat, 0 AS r4, '' AS div, 0 AS r6,
         '' AS prod, CASE n WHEN 2 THEN '{rp.BRAND} - ' || branch END AS t FROM p, range(0, 3) x(n)
  UNION ALL SELECT DISTINCT branch, year, month, 1, department, n, '', 0, '', 0, '',
         CASE n WHEN 0 THEN department ELSE 'Total By Department:' END FROM p, (VALUES (0), (2)) x(n)
  UNION ALL SELECT DISTINCT branch, year, month, 1, department, 1, category, n, '', 0, '',
         CASE n WHEN 0 THEN category ELSE 'Total By Category:' END FROM p, (VALUES (0), (2)) x(n)
  UNION ALL SELECT DISTINCT branch, year, month, 1, department, 1, category, 1, division, n, '',
         CASE n WHEN 0 THEN division ELSE 'Total By Division:' END FROM p, (VALUES (0), (2)) x(n)
  UNION ALL SELECT branch, year, month, 1, department, 1, category, 1, division, 1, product, product FROM p
  UNION ALL SELECT DISTINCT branch, year, month, 2, '', n, '', 0, '', 0, '',
         CASE n WHEN 0 THEN 'Catering' ELSE 'Total By Department:' END FROM p, range(0, 2) x(n) WHERE month = 3
  UNION ALL SELECT DISTINCT branch, year, month, 3, '', 0, '', 0, '', 0, '', 'Total By Branch:' FROM p WHERE month <> 2
  UNION ALL SELECT DISTINCT branch, year, month, 3, '', 1, '', 0, '', 0, '', 'Grand Total By Month:' FROM p WHERE month = 4)
, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch, year, month
                                     ORDER BY r0, dep, r2, cat, r4, div, r6, prod) AS line_no FROM l)
SELECT branch || '/' || CAST(year AS VARCHAR) || '/' || lpad(CAST(month AS VARCHAR), 2, '0') AS file, line_no,
       t AS description
FROM n WHERE t IS NOT NULL AND line_no <= 3 + 5"""))
def q_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows around the first NULL Division of every report file: up to three
    before and five after (D17f)."""
    parsed = parsed_item_report(spark, sf_dir, dense=True)
    # a row a file, kept so that the lines are joined to it without a shuffle
    first = cut_lineage(parsed.filter(F.col("Division").isNull()).groupBy("file").agg(F.min("line_no").alias("f")))
    ctx = parsed.join(first, "file").filter(F.col("line_no").between(F.col("f") - 3, F.col("f") + 5))
    return ctx.select(F.regexp_replace("file", "^rep14/", "").alias("file"), "line_no", F.col("desc").alias("description"))


def _scope_margin_sql(level: str, col: str, more: str = "") -> str:
    return with_items(f"""
SELECT branch AS Branch, {col} AS {level}, ROUND(SUM(c) + SUM(p), 4) AS Sales, ROUND(SUM(c), 4) AS COGS,
       ROUND(SUM(p), 4) AS GM, ROUND(SUM(q), 4) AS Qty,
       {R6("CASE WHEN SUM(c) + SUM(p) <> 0 THEN SUM(p) / (SUM(c) + SUM(p)) END")} AS GM_pct
FROM (SELECT branch, year, month, {col}, SUM(qty) AS q, ROUND(SUM(cost), 4) AS c, ROUND(SUM(profit), 4) AS p
      FROM items GROUP BY ALL {more})
GROUP BY ALL""")


def _scope_margin(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    from ..operators.margin import aggregate_margin
    tot = rp.report_totals(parsed_item_report(spark, sf_dir)).filter(F.col("total_scope") == level)
    tot = tot.withColumn("price", F.coalesce("cost", F.lit(0.0)) + F.coalesce("profit", F.lit(0.0)))   # C7
    m = aggregate_margin(tot, ["Branch", level])
    return m.select("Branch", level, rm("Sales").alias("Sales"), rm("COGS").alias("COGS"), rm("GM").alias("GM"),
                    rm("Qty").alias("Qty"), r6("GM_pct").alias("GM_pct"))


@register("q_margin_from_category_totals", _scope_margin_sql("Category", "category"))
def q_margin_from_category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margin by branch and category from the printed ``Total By
    Category`` rows of the parsed report, price repaired as cost + profit
    (D6f, C7, G1 - the notebook flow)."""
    return _scope_margin(spark, sf_dir, "Category")


@register("q_margin_from_department_totals", _scope_margin_sql(
    "Department", "department", "UNION ALL SELECT DISTINCT branch, year, month, 'Catering', 0, 0, 0 FROM items WHERE month = 3"))
def q_margin_from_department_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margin by branch and department from ``Total By Department`` rows."""
    return _scope_margin(spark, sf_dir, "Department")


@register("q_header_row", with_items("""
, b AS (SELECT year, COUNT(DISTINCT branch) + 2 AS page FROM items GROUP BY year)
, s AS (SELECT *, 1 + COALESCE(SUM(CASE WHEN year % 2 = 0 THEN page ELSE 2 * page END)
                  OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b)
SELECT 'rep134' AS file, CAST(start AS INTEGER) AS line_no, 'January' AS first_month, year % 2 = 0 AS all_months,
       1 AS branch_col FROM s
UNION ALL
SELECT 'rep134', CAST(start + page AS INTEGER), 'October', FALSE, 1 FROM s WHERE year % 2 = 1"""))
def q_header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month header rows of the paged monthly report, whether a row holds
    all twelve months, and the branch column found by token counts (A4, A5, A7)."""
    h = rp.header_rows(_report_monthly(spark, sf_dir, dense=True))
    return h.select("file", F.col("line_no").cast("int").alias("line_no"), "first_month", "all_months",
                    F.col("branch_col").cast("int").alias("branch_col"))


@register("q_parse_money", with_items("""
SELECT branch AS Branch, COUNT(*) AS n_items, COUNT(*) FILTER (WHERE p < 0) AS n_negative,
       ROUND(SUM(p), 4) AS profit
FROM (SELECT branch, year, month, department, category, division, product, ROUND(SUM(profit), 4) AS p
      FROM items GROUP BY ALL)
GROUP BY branch
UNION ALL SELECT NULL, n_apr, 0, 0.0 FROM gc WHERE n_apr > 0""", _GROUP_COUNTS))
def q_parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed money cells parsed back: thousands separators and
    parenthesised negatives (K1, K3, K6) - count, negatives and total of the
    item profit cells per branch."""
    parsed = parsed_item_report(spark, sf_dir)
    it = parsed.filter(~F.col("is_total") & ~F.col("is_open")).withColumn("p", rp.to_num(F.col("profit")))
    return it.groupBy("Branch").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("p") < 0).alias("n_negative"),
                                    rm(F.sum("p")).alias("profit"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group report written as text files into the shared folder and read back
    as lines and cells (A2, A3, A6, A8, A9)."""
    lines = rp.write_group_report(items(spark, sf_dir), dense=False)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/branchlens-reports/{uuid.uuid4().hex}"
    files.write_lines(lines.withColumn("gap", F.lit(None).cast("string")), path, ["desc", "qty", "gap", "amount", "amount"],
                      [" Description ", "Qty", "", "Total Amount", "Total Amount"])
    rows = files.with_header(files.read_lines(spark, path, folders=True), 1)
    named = {"desc": "Description", "qty": "Qty", "amount": "Total Amount_2"}
    return rows.select("file", "line_no", *[F.nullif(F.col(f"`{old}`"), F.lit("")).alias(new) for new, old in named.items()])


@register("q_report_files", with_items("""
SELECT branch AS Branch, division AS Division, COUNT(*) AS n_items, ROUND(SUM(qty), 4) AS Qty,
       ROUND(SUM(amount), 4) AS TotalAmount
FROM (SELECT branch, year, division, grp, product, SUM(qty) AS qty, ROUND(SUM(price), 4) AS amount FROM items GROUP BY ALL)
GROUP BY ALL"""))
def q_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files, written and read back through the text reader, parsed and
    summed by branch and division (A2, A3, A6, A8, A9, E2)."""
    it = rp.parse_group_report(report_files(spark, sf_dir)).filter(~F.col("is_total") & ~F.col("is_open"))
    return it.groupBy("Branch", "Division").agg(
        F.count(F.lit(1)).alias("n_items"), rm(F.sum(rp.to_num(F.col("qty")))).alias("Qty"),
        rm(F.sum(rp.to_num(F.col("amount")))).alias("TotalAmount"))


@register("q_scope_totals", with_items("""
, t AS (
  SELECT 'Division' AS scope, ROUND(SUM(cost), 4) AS c, round_even(SUM(profit), 0) AS p, SUM(qty) AS q FROM items
    GROUP BY branch, year, month, department, category, division
  UNION ALL SELECT 'Category', ROUND(SUM(cost), 4), ROUND(SUM(profit), 4), SUM(qty) FROM items GROUP BY branch, year, month, department, category
  UNION ALL SELECT 'Department', ROUND(SUM(cost), 4), ROUND(SUM(profit), 4), SUM(qty) FROM items GROUP BY branch, year, month, department
  UNION ALL SELECT 'Branch', ROUND(SUM(cost), 4), ROUND(SUM(profit), 4), SUM(qty) FROM items WHERE month <> 2 GROUP BY branch, year, month)
SELECT scope, COUNT(*) + CASE scope WHEN 'Department' THEN (SELECT n_mar FROM gc) ELSE 0 END AS n,
       ROUND(SUM(c), 4) AS Cost, ROUND(SUM(q), 4) AS Qty FROM t GROUP BY scope""", _GROUP_COUNTS))
def q_scope_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed totals of every scope with their cost and quantity (D5f, D6f)."""
    t = rp.report_totals(parsed_item_report(spark, sf_dir))
    return t.groupBy(F.col("total_scope").alias("scope")).agg(F.count(F.lit(1)).alias("n"), rm(F.sum("cost")).alias("Cost"),
                                                              rm(F.sum("qty")).alias("Qty"))


@register("q_price_repair", with_items("""
SELECT branch AS Branch, year, COUNT(*) AS n_items, COUNT(*) FILTER (WHERE lost) AS n_repaired, ROUND(SUM(p), 4) AS Sales
FROM (SELECT branch, year, ROUND(SUM(cost), 4) + ROUND(SUM(profit), 4) AS p, SUM(price) >= 100000 AS lost FROM items
      GROUP BY branch, year, month, department, category, division, product) GROUP BY ALL"""))
def q_price_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices recomputed as cost + profit, and how many printed ones had lost
    digits (C7, I19)."""
    parsed = parsed_item_report(spark, sf_dir).filter(~F.col("is_total") & ~F.col("is_open") & F.col("Branch").isNotNull())
    x = parsed.select("Branch", F.split("file", "/")[2].cast("int").alias("year"), rp.to_num(F.col("price")).alias("printed"),
                      (rp.to_num(F.col("cost")) + rp.to_num(F.col("profit"))).alias("p"))
    return x.groupBy("Branch", "year").agg(F.count(F.lit(1)).alias("n_items"),
                                           F.count_if(F.abs(F.col("p")) > 2 * F.abs(F.col("printed"))).alias("n_repaired"),
                                           rm(F.sum("p")).alias("Sales"))


@register("q_sparse_columns", with_items("""
, t AS (SELECT 2 * n_files - n_feb + 2 * (n_dep + n_mar + n_cat + n_div) + n_prod + n_apr AS n_lines, n_apr, n_files, n_feb FROM gc)
SELECT c AS "column" FROM t, (VALUES ('desc'), ('qty'), ('price'), ('cost'), ('profit'), ('Branch')) v(c)""", _GROUP_COUNTS))
def q_sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the parsed lines that stay when those at least 90 % empty are
    dropped; an added column with a value in one line of many goes (C3)."""
    parsed = parsed_item_report(spark, sf_dir).select("desc", "qty", "price", "cost", "profit", "Branch")
    parsed = parsed.withColumn("note", F.when(F.col("desc") == "Catering", F.lit("x")))
    kept = rp.drop_sparse(parsed)
    return spark.createDataFrame([(c,) for c in kept.columns], "column string")


@register("q_parse_money_zero", with_items("""
SELECT branch AS Branch, COUNT(*) FILTER (WHERE p >= 0) AS n_positive, ROUND(SUM(p) FILTER (WHERE p >= 0), 4) AS profit
FROM (SELECT branch, ROUND(SUM(profit), 4) AS p FROM items GROUP BY branch, year, month, department, category, division, product)
GROUP BY branch"""))
def q_parse_money_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit cells under the lenient rule, which reads a bracketed negative as 0
    (K2)."""
    it = parsed_item_report(spark, sf_dir).filter(~F.col("is_total") & ~F.col("is_open") & F.col("Branch").isNotNull())
    p = rp.to_num_zero(F.col("profit"))
    return it.groupBy("Branch").agg(F.count_if(~F.col("profit").startswith("(")).alias("n_positive"), rm(F.sum(p)).alias("profit"))


@register("q_parse_strict", with_items("""
SELECT branch AS Branch, ROUND(SUM(qty), 4) AS Qty FROM items GROUP BY branch"""))
def q_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity cells under the strict rule, which fails on any bad number (K4)."""
    it = parsed_item_report(spark, sf_dir).filter(~F.col("is_total") & ~F.col("is_open") & F.col("Branch").isNotNull())
    return it.groupBy("Branch").agg(rm(F.sum(rp.to_num_strict(F.col("qty")))).alias("Qty"))
