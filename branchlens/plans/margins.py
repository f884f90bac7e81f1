"""Margin queries: G1, G2, D11f, J1, J2, C5, C11, C12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import flag, guarded_ratio, r6, rm
from ..operators.margin import aggregate_margin, branch_department_features
from ..sources.tables import items, with_items
from .registry import register
from .sqlparts import R6

HEATMAP_MIN_SALES = 100000.0


def _margin_out(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, rm("Sales").alias("Sales"), rm("COGS").alias("COGS"), rm("GM").alias("GM"),
                     rm("Qty").alias("Qty"), r6("GM_pct").alias("GM_pct"))


def _margin_sql(keys: str) -> str:
    return with_items(f"""
SELECT {keys}, ROUND(SUM(price), 4) AS Sales, ROUND(SUM(cost), 4) AS COGS, ROUND(SUM(profit), 4) AS GM,
       ROUND(SUM(qty), 4) AS Qty,
       {R6("CASE WHEN SUM(price) <> 0 THEN SUM(profit) / SUM(price) END")} AS GM_pct
FROM items GROUP BY {keys}""")


@register("q_margin_branch_category", _margin_sql("branch, category"))
def q_margin_branch_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margin % by branch and category (G1)."""
    keys = ["branch", "category"]
    return _margin_out(aggregate_margin(items(spark, sf_dir), keys), keys)


@register("q_margin_branch_department", _margin_sql("branch, department"))
def q_margin_branch_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margin % by branch and department / channel."""
    keys = ["branch", "department"]
    return _margin_out(aggregate_margin(items(spark, sf_dir), keys), keys)


@register("q_margin_heatmap", with_items(f"""
, g AS (SELECT branch, category, SUM(price) AS Sales,
              CASE WHEN SUM(price) <> 0 THEN SUM(profit) / SUM(price) END AS GM_pct
        FROM items GROUP BY branch, category)
SELECT branch,
       {R6("MAX(GM_pct) FILTER (WHERE category = 'ECONOMY')")} AS "ECONOMY",
       {R6("MAX(GM_pct) FILTER (WHERE category = 'LARGE')")} AS "LARGE",
       {R6("MAX(GM_pct) FILTER (WHERE category = 'MEDIUM')")} AS "MEDIUM",
       {R6("MAX(GM_pct) FILTER (WHERE category = 'PROMO')")} AS "PROMO",
       {R6("MAX(GM_pct) FILTER (WHERE category = 'SMALL')")} AS "SMALL",
       {R6("MAX(GM_pct) FILTER (WHERE category = 'STANDARD')")} AS "STANDARD"
FROM g WHERE Sales > {HEATMAP_MIN_SALES} GROUP BY branch"""))
def q_margin_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch x category GM% matrix over cells with Sales > 100,000 (D11f, J1).

    The pivot values are the category domain of the part dimension (a bounded
    dimension scan, not a pass over the facts)."""
    it = items(spark, sf_dir)
    g = aggregate_margin(it, ["branch", "category"]).filter(F.col("Sales") > HEATMAP_MIN_SALES)
    return pivot_gm(g, "category", category_values(spark, sf_dir))


def category_values(spark: SparkSession, sf_dir: str) -> list[str]:
    from ..sources.tables import table
    return sorted(r[0] for r in table(spark, sf_dir, "part").select("p_type").distinct().collect())


def pivot_gm(g: DataFrame, key: str, values: list[str]) -> DataFrame:
    return (g.groupBy("branch").pivot(key, values).agg(F.first("GM_pct"))
            .select("branch", *[r6(F.col(f"`{v}`")).alias(v) for v in values]))


def rollout_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch feature row of the channel-rollout model."""
    feat = branch_department_features(items(spark, sf_dir))
    ta, tb = F.col("`Sales_TAKE AWAY`"), F.col("Sales_TABLE")
    total = F.coalesce(tb, F.lit(0.0)) + F.coalesce(ta, F.lit(0.0))
    return (feat
            .withColumn("Total_Sales", total)
            .withColumn("TA_Share", guarded_ratio(ta, F.col("Total_Sales"), 0.0))
            .withColumn("Table_Share", guarded_ratio(tb, F.col("Total_Sales"), 0.0))
            .withColumn("TA_OrderValue", guarded_ratio(ta, F.col("`Qty_TAKE AWAY`"), 0.0))
            .withColumn("Table_OrderValue", guarded_ratio(tb, F.col("Qty_TABLE"), 0.0))
            .withColumn("has_toters", flag("Sales_Toters").cast("boolean")))


_FEATURE_COLS = ["Sales_TABLE", "Cost_TABLE", "Profit_TABLE", "Qty_TABLE", "GM_pct_TABLE",
                 "Sales_TAKE AWAY", "Cost_TAKE AWAY", "Profit_TAKE AWAY", "Qty_TAKE AWAY", "GM_pct_TAKE AWAY",
                 "Sales_Toters", "Cost_Toters", "Profit_Toters", "Qty_Toters", "GM_pct_Toters"]


def _feat_sql_cols() -> str:
    parts = []
    for d in ("TABLE", "TAKE AWAY", "Toters"):
        cond = f"department = '{d}'"
        parts += [
            f'ROUND(SUM(price) FILTER (WHERE {cond}), 4) AS "Sales_{d}"',
            f'ROUND(SUM(cost) FILTER (WHERE {cond}), 4) AS "Cost_{d}"',
            f'ROUND(SUM(profit) FILTER (WHERE {cond}), 4) AS "Profit_{d}"',
            f'ROUND(SUM(qty) FILTER (WHERE {cond}), 4) AS "Qty_{d}"',
            R6(f'CASE WHEN SUM(price) FILTER (WHERE {cond}) <> 0 THEN SUM(profit) FILTER (WHERE {cond}) '
               f'/ SUM(price) FILTER (WHERE {cond}) END') + f' AS "GM_pct_{d}"',
        ]
    return ",\n       ".join(parts)


@register("q_branch_department_features", with_items(f"""
SELECT branch,
       {_feat_sql_cols()}
FROM items GROUP BY branch"""))
def q_branch_department_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide Metric_Department feature row per branch."""
    feat = branch_department_features(items(spark, sf_dir))
    out = []
    for c in _FEATURE_COLS:
        f = r6 if c.startswith("GM_pct") else rm
        out.append(f(F.col(f"`{c}`")).alias(c))
    return feat.select("branch", *out)


@register("q_rollout_features", with_items(f"""
, f AS (
  SELECT branch,
         SUM(price) FILTER (WHERE department = 'TABLE') AS s_tb,
         SUM(price) FILTER (WHERE department = 'TAKE AWAY') AS s_ta,
         SUM(price) FILTER (WHERE department = 'Toters') AS s_to,
         SUM(qty) FILTER (WHERE department = 'TABLE') AS q_tb,
         SUM(qty) FILTER (WHERE department = 'TAKE AWAY') AS q_ta
  FROM items GROUP BY branch)
SELECT branch,
       ROUND(COALESCE(s_tb, 0) + COALESCE(s_ta, 0), 4) AS Total_Sales,
       {R6("CASE WHEN COALESCE(s_tb, 0) + COALESCE(s_ta, 0) > 0 THEN s_ta / (COALESCE(s_tb, 0) + COALESCE(s_ta, 0)) ELSE 0 END")} AS TA_Share,
       {R6("CASE WHEN COALESCE(s_tb, 0) + COALESCE(s_ta, 0) > 0 THEN s_tb / (COALESCE(s_tb, 0) + COALESCE(s_ta, 0)) ELSE 0 END")} AS Table_Share,
       {R6("CASE WHEN q_ta > 0 THEN s_ta / q_ta ELSE 0 END")} AS TA_OrderValue,
       {R6("CASE WHEN q_tb > 0 THEN s_tb / q_tb ELSE 0 END")} AS Table_OrderValue,
       COALESCE(s_to, 0) > 0 AS has_toters
FROM f"""))
def q_rollout_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived rollout features: total sales, channel shares, order values,
    Toters flag (C8, C11, C12)."""
    f = rollout_features(spark, sf_dir)
    return f.select("branch", rm("Total_Sales").alias("Total_Sales"), r6("TA_Share").alias("TA_Share"),
                    r6("Table_Share").alias("Table_Share"), r6("TA_OrderValue").alias("TA_OrderValue"),
                    r6("Table_OrderValue").alias("Table_OrderValue"), "has_toters")
