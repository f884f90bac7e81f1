"""Reusable oracle SQL fragments (DuckDB dialect) mirroring the operators."""

from __future__ import annotations


def mode_cte(name: str, keys: str, val: str, src: str = "items") -> str:
    """Most frequent non-null ``val`` per ``keys``, smallest on ties."""
    return f"""{name} AS (
  SELECT {keys}, {val} AS mode_val FROM (
    SELECT {keys}, {val}, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY COUNT(*) DESC, {val}) AS rn
    FROM {src} WHERE {val} IS NOT NULL GROUP BY {keys}, {val}) WHERE rn = 1)"""


def product_table_ctes(key: str = "product") -> list[str]:
    """CTEs ending in ``pt``: the global product table (Product column)."""
    return [
        mode_cte("mcat", key, "category"),
        mode_cte("mdiv", key, "division"),
        """nb AS (SELECT COUNT(DISTINCT branch) AS n FROM items)""",
        f"""pr AS (
  SELECT {key} AS Product, SUM(price) AS Sales, SUM(cost) AS Cost, SUM(profit) AS Profit, SUM(qty) AS Qty,
         COUNT(DISTINCT branch) AS Branches,
         COALESCE(SUM(price) FILTER (WHERE department = 'TABLE'), 0) AS "TABLE",
         COALESCE(SUM(price) FILTER (WHERE department = 'TAKE AWAY'), 0) AS "TAKE AWAY",
         COALESCE(SUM(price) FILTER (WHERE department = 'Toters'), 0) AS "Toters"
  FROM items GROUP BY {key})""",
        f"""pt AS (
  SELECT pr.Product, mcat.mode_val AS Category, mdiv.mode_val AS Division, Sales, Cost, Profit, Qty, Branches,
         "TABLE", "TAKE AWAY", "Toters",
         CASE WHEN Sales > 0 THEN Profit / Sales END AS MarginPct,
         CASE WHEN Qty > 0 THEN Sales / Qty END AS AvgPrice,
         CASE WHEN Sales > 0 THEN "TABLE" / Sales ELSE 0 END AS TableShare,
         CASE WHEN Sales > 0 THEN "TAKE AWAY" / Sales ELSE 0 END AS TakeAwayShare,
         CASE WHEN Sales > 0 THEN "Toters" / Sales ELSE 0 END AS TotersShare,
         Branches / (SELECT n FROM nb) AS BranchPenetration,
         ln(1 + greatest(Sales, 0)) AS log_Sales,
         CASE WHEN Qty > 0 THEN ln(1 + greatest(Sales / Qty, 0)) END AS log_AvgPrice
  FROM pr LEFT JOIN mcat ON pr.Product = mcat.{key} LEFT JOIN mdiv ON pr.Product = mdiv.{key})""",
    ]


def branch_product_ctes(key: str = "product") -> list[str]:
    """CTEs ending in ``bpt``: the (branch, product) table."""
    return [
        mode_cte("bmcat", f"branch, {key}", "category"),
        mode_cte("bmdiv", f"branch, {key}", "division"),
        f"""bpr AS (
  SELECT branch, {key} AS Product, SUM(price) AS Sales, SUM(cost) AS Cost, SUM(profit) AS Profit, SUM(qty) AS Qty,
         COALESCE(SUM(price) FILTER (WHERE department = 'TABLE'), 0) AS "TABLE",
         COALESCE(SUM(price) FILTER (WHERE department = 'TAKE AWAY'), 0) AS "TAKE AWAY",
         COALESCE(SUM(price) FILTER (WHERE department = 'Toters'), 0) AS "Toters"
  FROM items GROUP BY branch, {key})""",
        """btot AS (SELECT branch, SUM(Sales) AS BranchSales, SUM(greatest(Profit, 0)) AS BranchPositiveProfit
  FROM bpr GROUP BY branch)""",
        f"""bpt AS (
  SELECT bpr.branch, bpr.Product, bmcat.mode_val AS Category, bmdiv.mode_val AS Division,
         Sales, Cost, Profit, Qty, "TABLE", "TAKE AWAY", "Toters",
         CASE WHEN Sales > 0 THEN Profit / Sales END AS MarginPct,
         CASE WHEN Qty > 0 THEN Sales / Qty END AS AvgPrice,
         CASE WHEN Sales > 0 THEN "TABLE" / Sales ELSE 0 END AS TableShare,
         CASE WHEN Sales > 0 THEN "TAKE AWAY" / Sales ELSE 0 END AS TakeAwayShare,
         CASE WHEN Sales > 0 THEN "Toters" / Sales ELSE 0 END AS TotersShare,
         BranchSales, BranchPositiveProfit,
         CASE WHEN BranchSales > 0 THEN Sales / BranchSales ELSE 0 END AS SalesShareInBranch,
         CASE WHEN BranchPositiveProfit > 0 THEN greatest(Profit, 0) / BranchPositiveProfit ELSE 0 END
           AS ProfitShareInBranch,
         ln(1 + greatest(Sales, 0)) AS log_Sales,
         CASE WHEN Qty > 0 THEN ln(1 + greatest(Sales / Qty, 0)) END AS log_AvgPrice
  FROM bpr JOIN btot ON bpr.branch = btot.branch
  LEFT JOIN bmcat ON bpr.branch = bmcat.branch AND bpr.Product = bmcat.{key}
  LEFT JOIN bmdiv ON bpr.branch = bmdiv.branch AND bpr.Product = bmdiv.{key})""",
    ]


def R6(expr: str, digits: int = 6) -> str:
    """Ratio rounding with the same tie nudge as the Spark side."""
    return f"ROUND(({expr}) * (1 + 1e-12), {digits})"


def round_select(cols_money, cols_ratio, cols_plain, src: str) -> str:
    parts = [f'"{c}"' for c in cols_plain]
    parts += [f'ROUND("{c}", 4) AS "{c}"' for c in cols_money]
    parts += [f'{R6(chr(34) + c + chr(34))} AS "{c}"' for c in cols_ratio]
    return f"SELECT {', '.join(parts)} FROM {src}"
