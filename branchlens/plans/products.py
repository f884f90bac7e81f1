"""Product-table queries: G3-G6, G8, G11, G12, J3, C8-C10, F1-F3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import r6, rounded
from ..operators.products import branch_product_table, product_table, with_global_shares
from ..sources.tables import items, with_items
from .registry import register
from .sqlparts import R6, branch_product_ctes, product_table_ctes, round_select

PT_MONEY = ["Sales", "Cost", "Profit", "Qty", "TABLE", "TAKE AWAY", "Toters"]
PT_RATIO = ["MarginPct", "AvgPrice", "TableShare", "TakeAwayShare", "TotersShare", "BranchPenetration",
            "log_Sales", "log_AvgPrice"]
BPT_MONEY = PT_MONEY + ["BranchSales", "BranchPositiveProfit"]
BPT_RATIO = ["MarginPct", "AvgPrice", "TableShare", "TakeAwayShare", "TotersShare", "SalesShareInBranch",
             "ProfitShareInBranch", "log_Sales", "log_AvgPrice"]


@register("q_product_table", with_items(round_select(
    PT_MONEY, PT_RATIO, ["Product", "Category", "Division", "Branches"], "pt"), *product_table_ctes()))
def q_product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global product rollup with channel pivot, margins, penetration, logs."""
    pt = product_table(items(spark, sf_dir))
    return rounded(pt.select("Product", "Category", "Division", "Branches", *PT_MONEY, *PT_RATIO),
                   PT_MONEY, PT_RATIO)


@register("q_branch_product_table", with_items(round_select(
    BPT_MONEY, BPT_RATIO, ["branch", "Product", "Category", "Division"], "bpt"), *branch_product_ctes()))
def q_branch_product_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(branch, product) rollup with in-branch sales/profit shares."""
    t = branch_product_table(items(spark, sf_dir))
    return rounded(t.select("branch", "Product", "Category", "Division", *BPT_MONEY, *BPT_RATIO),
                   BPT_MONEY, BPT_RATIO)


@register("q_sales_share", with_items(f"""
SELECT Product, ROUND(Sales, 4) AS Sales, ROUND(Profit, 4) AS Profit,
       {R6("CASE WHEN (SELECT SUM(Sales) FROM pt) > 0 THEN Sales / (SELECT SUM(Sales) FROM pt) ELSE 0 END", 9)}
         AS SalesShare,
       {R6("CASE WHEN (SELECT SUM(Profit) FROM pt) <> 0 THEN Profit / (SELECT SUM(Profit) FROM pt) ELSE 0 END", 9)}
         AS ProfitShare
FROM pt""", *product_table_ctes()))
def q_sales_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each product in global sales and profit."""
    pt = with_global_shares(product_table(items(spark, sf_dir)))
    return pt.select("Product", F.round("Sales", 4).alias("Sales"), F.round("Profit", 4).alias("Profit"),
                     r6("SalesShare", 9).alias("SalesShare"), r6("ProfitShare", 9).alias("ProfitShare"))


@register("q_value_counts", with_items("""
SELECT division, COUNT(*) AS n FROM items GROUP BY division"""))
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency table of Division over item rows."""
    return items(spark, sf_dir).groupBy("division").agg(F.count(F.lit(1)).alias("n"))


@register("q_distinct_branches", with_items("""
SELECT COUNT(DISTINCT branch) AS n_branches,
       COUNT(DISTINCT branch) + MAX(CASE WHEN branch IS NULL THEN 1 ELSE 0 END) AS n_branch_values,
       COUNT(DISTINCT product) AS n_products,
       (SELECT COUNT(*) FROM (SELECT category AS v FROM items UNION SELECT division FROM items)) AS n_category_or_division
FROM items"""))
def q_distinct_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct branch counts with and without a null key, distinct products,
    distinct values of the union of two columns (G11, G14)."""
    it = items(spark, sf_dir)
    union_n = (it.select(F.col("category").alias("v")).union(it.select("division"))
               .distinct().select(F.count(F.lit(1))).scalar())
    return it.agg(
        F.count_distinct("branch").alias("n_branches"),
        (F.count_distinct("branch") + F.max(F.when(F.col("branch").isNull(), 1).otherwise(0)))
        .alias("n_branch_values"),
        F.count_distinct("product").alias("n_products"),
    ).withColumn("n_category_or_division", union_n)
