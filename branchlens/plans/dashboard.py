"""Dashboard queries (M1, M8, M9, M13, M14, M16, M17, G18-G21, H17, H18,
I2-I5, D19f) over a tiered product table.

Each dashboard query is a function of an assignments table (branch, Product,
Sales, Profit, MarginPct, channel shares, Cluster, SuccessRank, SuccessTier)
computed for all branches at once; a branch slice is a filter on it. The
registered versions use a deterministic segmentation (cluster = product
category) so they are exact and SQL-checkable; ``plans.clustering.branch_run``
feeds the same functions with k-means tiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6, rm
from ..operators import profiles as pf
from ..operators.products import branch_product_table
from ..operators.quantiles import group_quantiles
from ..session import cut_lineage
from ..sources.tables import items, with_items
from .clustering import SILHOUETTE_SQL, silhouette_by_type
from .registry import register
from .sqlparts import R6, branch_product_ctes

GRAIN = "family"
TOP_TIER_N = 12
BOTTOM_N = 10
LOW_MARGIN_N = 10
# Channel display names in the dashboard's order.
CHANNELS = (("TakeAwayShare", "Take Away"), ("TableShare", "Table"), ("TotersShare", "Toters"))


def rule_tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(assignments, profiles) with Cluster = rank of the product's category
    in the category domain (a bounded dimension, joined back)."""
    bt = branch_product_table(items(spark, sf_dir), product=GRAIN)
    cats = (bt.select("Category").distinct()
            .withColumn("Cluster", (F.dense_rank().over(Window.orderBy("Category")) - 1).cast("int")))
    a = bt.join(cats, "Category")
    prof = pf.success_tiers(pf.profiles(a, ["branch"], per_branch=True), ["branch"])
    tiers = prof.select("branch", "Cluster", "SuccessRank", "SuccessTier")
    return a.join(tiers, ["branch", "Cluster"]), prof


def _tier_sql(name: str, rank: str, total: str) -> str:
    return (f"CASE WHEN {rank} = 1 THEN '{pf.TIER_MOST[0]}' WHEN {rank} = {total} THEN '{pf.TIER_LEAST[0]}' "
            f"WHEN {rank} <= greatest(2, floor({total} / 2)) THEN '{pf.TIER_STRONG[0]}' ELSE '{pf.TIER_MID[0]}' END")


def _z(c: str) -> str:
    return (f"CASE WHEN STDDEV_POP({c}) OVER (PARTITION BY branch) IS NULL OR STDDEV_POP({c}) OVER (PARTITION BY branch) = 0 "
            f"THEN 0 ELSE ({c} - AVG({c}) OVER (PARTITION BY branch)) / STDDEV_POP({c}) OVER (PARTITION BY branch) END")


RULE_CTES = branch_product_ctes("family") + [
    """cats AS (SELECT Category, CAST(DENSE_RANK() OVER (ORDER BY Category) - 1 AS INTEGER) AS Cluster
        FROM (SELECT DISTINCT Category FROM bpt))""",
    """asg0 AS (SELECT bpt.*, cats.Cluster FROM bpt JOIN cats ON bpt.Category = cats.Category)""",
    """prof0 AS (SELECT branch, Cluster, COUNT(Product) AS n_products, SUM(Sales) AS total_sales,
        SUM(Profit) AS total_profit, MEDIAN(Sales) AS median_sales, MEDIAN(Profit) AS median_profit,
        MEDIAN(MarginPct) AS median_margin_pct, AVG(TakeAwayShare) AS avg_takeaway_share,
        AVG(TableShare) AS avg_table_share, AVG(TotersShare) AS avg_toters_share
        FROM asg0 GROUP BY branch, Cluster)""",
    f"""prof1 AS (SELECT *, 0.5 * ({_z("median_sales")}) + 0.35 * ({_z("median_profit")})
        + 0.15 * ({_z("median_margin_pct")}) AS SuccessScore,
        CASE WHEN SUM(total_sales) OVER (PARTITION BY branch) > 0
             THEN total_sales / SUM(total_sales) OVER (PARTITION BY branch) ELSE 0 END AS sales_share,
        CASE WHEN SUM(total_profit) OVER (PARTITION BY branch) <> 0
             THEN total_profit / SUM(total_profit) OVER (PARTITION BY branch) ELSE 0 END AS profit_share
        FROM prof0)""",
    """prof2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY SuccessScore DESC NULLS LAST, Cluster)
        AS SuccessRank, COUNT(*) OVER (PARTITION BY branch) AS n_tiers FROM prof1)""",
    f"""prof AS (SELECT *, 'Tier ' || CAST(SuccessRank AS VARCHAR) || ': ' || {_tier_sql("t", "SuccessRank", "n_tiers")}
        AS SuccessTier FROM prof2)""",
    """asg AS (SELECT asg0.*, prof.SuccessRank, prof.SuccessTier FROM asg0
        JOIN prof ON asg0.branch = prof.branch AND asg0.Cluster = prof.Cluster)""",
]


@register("q_success_tiers_rule", with_items(f"""
SELECT branch, Cluster, n_products, ROUND(total_sales, 4) AS total_sales, ROUND(total_profit, 4) AS total_profit,
       {R6("median_sales", 4)} AS median_sales, {R6("median_profit", 4)} AS median_profit,
       {R6("median_margin_pct")} AS median_margin_pct, {R6("sales_share")} AS sales_share,
       {R6("SuccessScore")} AS SuccessScore, SuccessRank, SuccessTier FROM prof""", *RULE_CTES))
def q_success_tiers_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-branch segment profiles, z-score SuccessScore, rank and tier with
    a deterministic segmentation (G7, G8, H2-H4, K15)."""
    _, prof = rule_tiers(spark, sf_dir)
    return prof.select("branch", "Cluster", "n_products", rm("total_sales").alias("total_sales"),
                       rm("total_profit").alias("total_profit"), r6("median_sales", 4).alias("median_sales"),
                       r6("median_profit", 4).alias("median_profit"), r6("median_margin_pct").alias("median_margin_pct"),
                       r6("sales_share").alias("sales_share"), r6("SuccessScore").alias("SuccessScore"),
                       F.col("SuccessRank").cast("bigint").alias("SuccessRank"), "SuccessTier")


def _ranked(a: DataFrame, order, n: int, where=None) -> DataFrame:
    x = a if where is None else a.filter(where)
    w = Window.partitionBy("branch").orderBy(*order)
    return x.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


OUT = ["branch", "rank", "Product", "SuccessTier", "Cluster"]


def _out(df: DataFrame) -> DataFrame:
    return df.select(*OUT, rm("Sales").alias("Sales"), rm("Profit").alias("Profit"),
                     r6("MarginPct").alias("MarginPct"), rm("Qty").alias("Qty"))


def _out_sql(src: str) -> str:
    return (f"SELECT branch, rank, Product, SuccessTier, Cluster, ROUND(Sales, 4) AS Sales, ROUND(Profit, 4) AS Profit, "
            f"{R6('MarginPct')} AS MarginPct, ROUND(Qty, 4) AS Qty FROM {src}")


@register("q_top_products", with_items(f"""
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY Sales DESC, Product) AS rank FROM asg
        WHERE SuccessRank = 1)
{_out_sql(f"r WHERE rank <= {TOP_TIER_N}")}""", *RULE_CTES))
def q_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-12 products of the best tier per branch by sales (M8, M16, D19f, I2, I5)."""
    a, _ = rule_tiers(spark, sf_dir)
    return _out(_ranked(a, [F.desc("Sales"), "Product"], TOP_TIER_N, F.col("SuccessRank") == 1))


@register("q_bottom_products", with_items(f"""
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY Sales, Profit, Product) AS rank FROM asg)
{_out_sql(f"r WHERE rank <= {BOTTOM_N}")}""", *RULE_CTES))
def q_bottom_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-10 products per branch by (Sales, Profit)."""
    a, _ = rule_tiers(spark, sf_dir)
    return _out(_ranked(a, ["Sales", "Profit", "Product"], BOTTOM_N))


@register("q_low_margin", with_items(f"""
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY MarginPct NULLS LAST, Product) AS rank FROM asg)
{_out_sql(f"r WHERE rank <= {LOW_MARGIN_N}")}""", *RULE_CTES))
def q_low_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest-margin 10 products per branch."""
    a, _ = rule_tiers(spark, sf_dir)
    return _out(_ranked(a, [F.asc_nulls_last("MarginPct"), "Product"], LOW_MARGIN_N))


@register("q_branch_summary", with_items(f"""
SELECT a.branch, ROUND(SUM(Sales), 4) AS total_sales, ROUND(SUM(Profit), 4) AS total_profit,
       {R6("CASE WHEN SUM(Sales) > 0 THEN SUM(Profit) / SUM(Sales) ELSE 0 END")} AS margin_pct,
       COUNT(*) AS n_products, COUNT(*) FILTER (WHERE Profit < 0) AS n_loss_making,
       MIN(t.SuccessTier) AS top_tier
FROM asg a JOIN (SELECT branch, SuccessTier FROM prof WHERE SuccessRank = 1) t ON a.branch = t.branch
GROUP BY a.branch""", *RULE_CTES))
def q_branch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch KPIs: sales, profit, margin, product count, loss makers, top
    tier (M1, M2, G18, D14f)."""
    a, prof = rule_tiers(spark, sf_dir)
    top = prof.filter(F.col("SuccessRank") == 1).select("branch", F.col("SuccessTier").alias("top_tier"))
    s = a.groupBy("branch").agg(F.sum("Sales").alias("ts"), F.sum("Profit").alias("tp"),
                                F.count(F.lit(1)).alias("n_products"),
                                F.count_if(F.col("Profit") < 0).alias("n_loss_making"))
    return s.join(top, "branch").select(
        "branch", rm("ts").alias("total_sales"), rm("tp").alias("total_profit"),
        r6(F.when(F.col("ts") > 0, F.col("tp") / F.col("ts")).otherwise(F.lit(0.0))).alias("margin_pct"),
        "n_products", "n_loss_making", "top_tier")


def _dominant_channel_expr():
    cols = [F.col(c) for c, _ in CHANNELS]
    top = F.greatest(*cols)
    out = None
    for (c, label) in CHANNELS:
        cond = F.col(c) >= top
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


@register("q_margin_by_channel", with_items(f"""
, d AS (SELECT *, CASE WHEN TakeAwayShare >= greatest(TakeAwayShare, TableShare, TotersShare) THEN 'Take Away'
                       WHEN TableShare >= greatest(TakeAwayShare, TableShare, TotersShare) THEN 'Table'
                       ELSE 'Toters' END AS DominantChannel FROM asg)
SELECT branch, DominantChannel, {R6("AVG(MarginPct)")} AS avg_margin, COUNT(Product) AS n_products,
       ROUND(SUM(Profit), 4) AS total_profit,
       CASE DominantChannel WHEN 'Take Away' THEN 0 WHEN 'Table' THEN 1 ELSE 2 END AS sort_key
FROM d GROUP BY branch, DominantChannel""", *RULE_CTES))
def q_margin_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant channel per product (first of Take Away, Table, Toters on
    ties), then mean margin, product count and profit per channel (M14, H17, G21)."""
    a, _ = rule_tiers(spark, sf_dir)
    d = a.withColumn("DominantChannel", _dominant_channel_expr())
    order = F.when(F.col("DominantChannel") == "Take Away", 0).when(F.col("DominantChannel") == "Table", 1).otherwise(2)
    return (d.groupBy("branch", "DominantChannel")
            .agg(r6(F.avg("MarginPct")).alias("avg_margin"), F.count("Product").alias("n_products"),
                 rm(F.sum("Profit")).alias("total_profit"))
            .withColumn("sort_key", order))


@register("q_channel_leaders", with_items(f"""
, s AS (SELECT branch, SuccessTier, MIN(SuccessRank) AS rk, AVG(TakeAwayShare) AS ta, AVG(TableShare) AS tb,
               AVG(TotersShare) AS tt FROM asg GROUP BY branch, SuccessTier)
, u AS (SELECT branch, 'Take Away' AS channel, SuccessTier, rk, ta AS v FROM s
        UNION ALL SELECT branch, 'Table', SuccessTier, rk, tb FROM s
        UNION ALL SELECT branch, 'Toters', SuccessTier, rk, tt FROM s)
SELECT branch, channel, SuccessTier AS leader, {R6("v")} AS share FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY branch, channel ORDER BY v DESC, rk) AS rn FROM u) WHERE rn = 1""",
                                          *RULE_CTES))
def q_channel_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier with the highest mean share of each channel per branch."""
    a, _ = rule_tiers(spark, sf_dir)
    s = a.groupBy("branch", "SuccessTier").agg(F.min("SuccessRank").alias("rk"),
                                               *[F.avg(c).alias(c) for c, _ in CHANNELS])
    out = None
    for c, label in CHANNELS:
        # ties -> the better-ranked tier (profiles are read in rank order)
        one = s.groupBy("branch").agg(F.lit(label).alias("channel"),
                                      F.max_by("SuccessTier", F.struct(F.col(c), -F.col("rk"))).alias("leader"),
                                      r6(F.max(c)).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------ more views
HIST_BINS = 45
ALL_BRANCHES_LABEL = "All Branches (Combined)"
# Tier colours of the dashboard (substring rules, first match wins).
TIER_COLOURS = (("most successful", "#0F8A78"), ("least successful", "#B84A2A"), ("strong", "#D8973C"))
TIER_COLOUR_DEFAULT = "#5A6F57"


@register("q_kpis", with_items(f"""{SILHOUETTE_SQL}
, sil AS (SELECT branch, AVG(v) AS silhouette FROM si GROUP BY branch)
SELECT a.branch, ROUND(SUM(Sales), 4) AS total_sales, ROUND(SUM(Profit), 4) AS total_profit,
       COUNT(*) AS n_products, COUNT(DISTINCT a.Cluster) AS selected_k, {R6("MIN(sil.silhouette)", 9)} AS silhouette,
       MIN(t.SuccessTier) AS top_tier, {R6("MIN(t.sales_share)")} AS top_tier_share
FROM asg a JOIN (SELECT branch, SuccessTier, sales_share FROM prof WHERE SuccessRank = 1) t ON a.branch = t.branch
JOIN sil ON a.branch = sil.branch
GROUP BY a.branch""", *RULE_CTES))
def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI cards per branch: sales, profit, product count, number of clusters and
    their silhouette, top tier and its sales share (M2, G18)."""
    a, prof = rule_tiers(spark, sf_dir)
    top = prof.filter(F.col("SuccessRank") == 1).select("branch", F.col("SuccessTier").alias("top_tier"),
                                                        F.col("sales_share").alias("top_tier_share"))
    s = a.groupBy("branch").agg(rm(F.sum("Sales")).alias("total_sales"), rm(F.sum("Profit")).alias("total_profit"),
                                F.count(F.lit(1)).alias("n_products"), F.countDistinct("Cluster").alias("selected_k"))
    return s.join(top, "branch").join(silhouette_by_type(spark, sf_dir), "branch").select(
        "branch", "total_sales", "total_profit", "n_products", "selected_k", r6("silhouette", 9).alias("silhouette"),
        "top_tier", r6("top_tier_share").alias("top_tier_share"))


@register("q_insights", with_items(f"""
, ch AS (SELECT branch, AVG(TakeAwayShare) AS ta, AVG(TableShare) AS tb, AVG(TotersShare) AS tt,
                SUM(Sales) AS s, SUM(Profit) AS p, COUNT(*) FILTER (WHERE Profit < 0) AS n_loss FROM asg GROUP BY branch)
, best AS (SELECT branch, SuccessTier AS best_tier, sales_share AS best_share FROM prof WHERE SuccessRank = 1)
, worst AS (SELECT branch, SuccessTier AS worst_tier, sales_share AS worst_share FROM prof
            WHERE SuccessRank = n_tiers)
, top AS (SELECT branch, Product AS best_seller, Sales AS best_seller_sales FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY Sales DESC, Product) AS rn FROM asg) WHERE rn = 1)
, low AS (SELECT branch, Product AS lowest_seller, Sales AS lowest_seller_sales FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY Sales, Product) AS rn FROM asg) WHERE rn = 1)
, lm AS (SELECT branch, Product AS lowest_margin_product, MarginPct AS lowest_margin FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY MarginPct NULLS LAST, Product) AS rn FROM asg)
         WHERE rn = 1)
SELECT ch.branch, best_tier, {R6("best_share")} AS best_share, worst_tier, {R6("worst_share")} AS worst_share,
       CASE WHEN ta >= greatest(ta, tb, tt) THEN 'Take Away' WHEN tb >= greatest(ta, tb, tt) THEN 'Table'
            ELSE 'Toters' END AS dominant_channel, {R6("greatest(ta, tb, tt)")} AS dominant_channel_share,
       best_seller, ROUND(best_seller_sales, 4) AS best_seller_sales, lowest_seller,
       ROUND(lowest_seller_sales, 4) AS lowest_seller_sales,
       {R6("CASE WHEN s > 0 THEN p / s ELSE 0 END")} AS overall_margin, n_loss,
       lowest_margin_product, {R6("lowest_margin")} AS lowest_margin
FROM ch JOIN best ON ch.branch = best.branch JOIN worst ON ch.branch = worst.branch
JOIN top ON ch.branch = top.branch JOIN low ON ch.branch = low.branch JOIN lm ON ch.branch = lm.branch""",
                                     *RULE_CTES))
def q_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insight facts per branch: best/worst tier and their sales share,
    dominant channel (first of Take Away, Table, Toters on ties), best and
    lowest seller, overall margin, loss makers, lowest-margin product (M3,
    G18, G20, I7)."""
    a, prof = rule_tiers(spark, sf_dir)
    n_t = prof.groupBy("branch").agg(F.max("SuccessRank").alias("_nt"))
    best = prof.filter(F.col("SuccessRank") == 1).select("branch", F.col("SuccessTier").alias("best_tier"),
                                                         F.col("sales_share").alias("best_share"))
    worst = (prof.join(n_t, "branch").filter(F.col("SuccessRank") == F.col("_nt"))
             .select("branch", F.col("SuccessTier").alias("worst_tier"), F.col("sales_share").alias("worst_share")))
    ta, tb, tt = F.col("ta"), F.col("tb"), F.col("tt")
    top3 = F.greatest(ta, tb, tt)
    ch = a.groupBy("branch").agg(
        F.avg("TakeAwayShare").alias("ta"), F.avg("TableShare").alias("tb"), F.avg("TotersShare").alias("tt"),
        F.sum("Sales").alias("s"), F.sum("Profit").alias("p"), F.count_if(F.col("Profit") < 0).alias("n_loss"),
        F.min_by(F.struct("Product", "Sales"), F.struct(-F.col("Sales"), F.col("Product"))).alias("top"),
        F.min_by(F.struct("Product", "Sales"), F.struct(F.col("Sales"), F.col("Product"))).alias("low"),
        F.min_by(F.struct("Product", "MarginPct"),
                 F.struct(F.col("MarginPct").isNull(), F.col("MarginPct"), F.col("Product"))).alias("lm"))
    ch = ch.select(
        "branch",
        F.when(ta >= top3, "Take Away").when(tb >= top3, "Table").otherwise("Toters").alias("dominant_channel"),
        r6(top3).alias("dominant_channel_share"),
        F.col("top.Product").alias("best_seller"), rm("top.Sales").alias("best_seller_sales"),
        F.col("low.Product").alias("lowest_seller"), rm("low.Sales").alias("lowest_seller_sales"),
        r6(F.when(F.col("s") > 0, F.col("p") / F.col("s")).otherwise(0.0)).alias("overall_margin"), "n_loss",
        F.col("lm.Product").alias("lowest_margin_product"), r6("lm.MarginPct").alias("lowest_margin"))
    return (ch.join(best, "branch").join(worst, "branch")
            .select("branch", "best_tier", r6("best_share").alias("best_share"), "worst_tier",
                    r6("worst_share").alias("worst_share"), "dominant_channel", "dominant_channel_share",
                    "best_seller", "best_seller_sales", "lowest_seller", "lowest_seller_sales", "overall_margin",
                    "n_loss", "lowest_margin_product", "lowest_margin"))


@register("q_branch_margin_extremes", with_items(f"""
, b AS (SELECT branch, SUM(Sales) AS s, SUM(Profit) AS p FROM asg GROUP BY branch HAVING SUM(Sales) > 0)
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT branch FROM asg)) AS n_branches,
       (SELECT branch FROM b ORDER BY p / s DESC, branch LIMIT 1) AS best_branch,
       {R6("(SELECT MAX(p / s) FROM b)")} AS best_margin,
       (SELECT branch FROM b ORDER BY p / s, branch LIMIT 1) AS worst_branch,
       {R6("(SELECT MIN(p / s) FROM b)")} AS worst_margin""", *RULE_CTES))
def q_branch_margin_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined view: branch count, best and worst branch by margin among
    branches with sales (G19, M3)."""
    a, _ = rule_tiers(spark, sf_dir)
    b = (a.groupBy("branch").agg(F.sum("Sales").alias("s"), F.sum("Profit").alias("p"))
         .filter(F.col("s") > 0).withColumn("m", F.col("p") / F.col("s")))
    return b.agg(F.count(F.lit(1)).alias("n_branches"),
                 F.min_by("branch", F.struct(-F.col("m"), F.col("branch"))).alias("best_branch"),
                 r6(F.max("m")).alias("best_margin"),
                 F.min_by("branch", F.struct(F.col("m"), F.col("branch"))).alias("worst_branch"),
                 r6(F.min("m")).alias("worst_margin"))


@register("q_margin_hist", with_items(f"""
, r AS (SELECT branch, MIN(MarginPct) AS lo, MAX(MarginPct) AS hi FROM asg GROUP BY branch)
, b AS (SELECT a.branch, CASE WHEN r.hi = r.lo THEN 0
               ELSE LEAST(CAST(FLOOR((MarginPct - r.lo) / (r.hi - r.lo) * {HIST_BINS}) AS INTEGER), {HIST_BINS - 1}) END
               AS bin, r.lo, r.hi
        FROM asg a JOIN r ON a.branch = r.branch WHERE MarginPct IS NOT NULL)
SELECT branch, bin, {R6(f"lo + bin * (hi - lo) / {HIST_BINS}")} AS bin_start, COUNT(*) AS n_products
FROM b GROUP BY branch, bin, lo, hi""", *RULE_CTES))
def q_margin_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """45 equal-width MarginPct bins between the branch's min and max."""
    a, _ = rule_tiers(spark, sf_dir)
    a = a.filter(F.col("MarginPct").isNotNull())
    r = a.groupBy("branch").agg(F.min("MarginPct").alias("lo"), F.max("MarginPct").alias("hi"))
    width = F.col("hi") - F.col("lo")
    bin_ = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("MarginPct") - F.col("lo")) / width * HIST_BINS).cast("int"), F.lit(HIST_BINS - 1)))
    b = a.join(r, "branch").withColumn("bin", bin_)
    return (b.groupBy("branch", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n_products"))
            .select("branch", "bin", r6(F.col("lo") + F.col("bin") * width / HIST_BINS).alias("bin_start"),
                    "n_products"))


@register("q_margin_box", with_items(f"""
, q AS (SELECT branch, SuccessTier, MIN(SuccessRank) AS rk, COUNT(MarginPct) AS n,
               QUANTILE_CONT(MarginPct, 0.25) AS q1, MEDIAN(MarginPct) AS med, QUANTILE_CONT(MarginPct, 0.75) AS q3
        FROM asg GROUP BY branch, SuccessTier)
, j AS (SELECT a.MarginPct, q.* FROM asg a JOIN q ON a.branch = q.branch AND a.SuccessTier = q.SuccessTier
        WHERE a.MarginPct IS NOT NULL)
SELECT branch, SuccessTier, n, {R6("q1")} AS q1, {R6("med")} AS median, {R6("q3")} AS q3,
       {R6("MIN(MarginPct) FILTER (WHERE MarginPct >= q1 - 1.5 * (q3 - q1))")} AS whisker_low,
       {R6("MAX(MarginPct) FILTER (WHERE MarginPct <= q3 + 1.5 * (q3 - q1))")} AS whisker_high,
       COUNT(*) FILTER (WHERE MarginPct < q1 - 1.5 * (q3 - q1) OR MarginPct > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM j GROUP BY branch, SuccessTier, n, q1, med, q3""", *RULE_CTES))
def q_margin_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of MarginPct per tier: quartiles, 1.5 IQR whiskers,
    suspected outliers (G23, M10)."""
    a, _ = rule_tiers(spark, sf_dir)
    a = cut_lineage(a.select("branch", "SuccessTier", "MarginPct"))
    q = group_quantiles(a, ["branch", "SuccessTier"], ["MarginPct"], [0.25, 0.5, 0.75])
    q = q.select("branch", "SuccessTier", *[F.col("MarginPct_q")[i].alias(n) for i, n in enumerate(("q1", "med", "q3"))])
    n = a.groupBy("branch", "SuccessTier").agg(F.count("MarginPct").alias("n"))
    q = q.join(n, ["branch", "SuccessTier"])
    j = a.filter(F.col("MarginPct").isNotNull()).join(q, ["branch", "SuccessTier"])
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    m = F.col("MarginPct")
    return (j.groupBy("branch", "SuccessTier", "n", "q1", "med", "q3")
            .agg(F.min(F.when(m >= lo, m)).alias("wl"), F.max(F.when(m <= hi, m)).alias("wh"),
                 F.count_if((m < lo) | (m > hi)).alias("n_outliers"))
            .select("branch", "SuccessTier", "n", r6("q1").alias("q1"), r6("med").alias("median"),
                    r6("q3").alias("q3"), r6("wl").alias("whisker_low"), r6("wh").alias("whisker_high"),
                    "n_outliers"))


def tier_axis_label(c):
    """``Tier <n>`` / ``C<n>`` / first three words."""
    t = F.trim(c)
    tier = F.regexp_extract(t, r"(?i)^Tier\s*(\d+)", 1)
    clus = F.regexp_extract(t, r"(?i)^(C\d+)", 1)
    words = F.split(t, r"\s+")
    return (F.when(tier != "", F.concat(F.lit("Tier "), tier)).when(clus != "", F.upper(clus))
            .when(F.size(words) <= 3, t).otherwise(F.array_join(F.slice(words, 1, 3), " ")))


def tier_colour(c):
    """Ordered substring rules on the lower-cased tier name."""
    low = F.lower(c)
    out = None
    for key, colour in TIER_COLOURS:
        out = F.when(low.contains(key), F.lit(colour)) if out is None else out.when(low.contains(key), F.lit(colour))
    return out.otherwise(F.lit(TIER_COLOUR_DEFAULT))


def _tier_axis_sql(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '^Tier\\s*\\d+', 'i') THEN 'Tier ' || regexp_extract({c}, '^Tier\\s*(\\d+)', 1, 'i') "
            f"WHEN regexp_matches({c}, '^C\\d+', 'i') THEN upper(regexp_extract({c}, '^(C\\d+)', 1, 'i')) "
            f"WHEN len(regexp_split_to_array(trim({c}), '\\s+')) <= 3 THEN trim({c}) "
            f"ELSE array_to_string(regexp_split_to_array(trim({c}), '\\s+')[1:3], ' ') END")


def _tier_colour_sql(c: str) -> str:
    parts = " ".join(f"WHEN contains(lower({c}), '{k}') THEN '{v}'" for k, v in TIER_COLOURS)
    return f"CASE {parts} ELSE '{TIER_COLOUR_DEFAULT}' END"


@register("q_cluster_mix", with_items(f"""
SELECT branch, SuccessRank, SuccessTier, {_tier_axis_sql("SuccessTier")} AS TierAxis,
       {_tier_colour_sql("SuccessTier")} AS TierColor, n_products, {R6("sales_share")} AS sales_share,
       {R6("profit_share")} AS profit_share FROM prof""", *RULE_CTES))
def q_cluster_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier mix per branch: axis label, colour, products, sales and profit
    share in rank order (M5, M15, K12, K13)."""
    _, prof = rule_tiers(spark, sf_dir)
    return prof.select("branch", F.col("SuccessRank").cast("bigint").alias("SuccessRank"), "SuccessTier",
                       tier_axis_label(F.col("SuccessTier")).alias("TierAxis"),
                       tier_colour(F.col("SuccessTier")).alias("TierColor"), "n_products",
                       r6("sales_share").alias("sales_share"), r6("profit_share").alias("profit_share"))


@register("q_channel_matrix", with_items(f"""
SELECT branch, SuccessTier, channel, {R6("share")} AS share FROM (
  SELECT branch, SuccessTier, 'Take Away' AS channel, avg_takeaway_share AS share FROM prof UNION ALL
  SELECT branch, SuccessTier, 'Table', avg_table_share FROM prof UNION ALL
  SELECT branch, SuccessTier, 'Toters', avg_toters_share FROM prof)""", *RULE_CTES))
def q_channel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier x channel matrix of mean channel shares, long."""
    _, prof = rule_tiers(spark, sf_dir)
    cols = [("avg_takeaway_share", "Take Away"), ("avg_table_share", "Table"), ("avg_toters_share", "Toters")]
    st = F.array(*[F.struct(F.lit(lbl).alias("channel"), F.col(c).alias("share")) for c, lbl in cols])
    return (prof.select("branch", "SuccessTier", F.explode(st).alias("s"))
            .select("branch", "SuccessTier", "s.channel", r6("s.share").alias("share")))


@register("q_performance_map", with_items(f"""
SELECT branch, Product, SuccessTier, {_tier_colour_sql("SuccessTier")} AS TierColor, ROUND(Sales, 4) AS Sales,
       ROUND(Profit, 4) AS Profit, ROUND(Qty, 4) AS Qty, {R6("MarginPct")} AS MarginPct,
       {R6("GREATEST(Sales, 1)")} AS SalesForPlot,
       ROW_NUMBER() OVER (PARTITION BY branch ORDER BY Qty DESC, Product) AS draw_order FROM asg""", *RULE_CTES))
def q_performance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scatter rows per branch: sales, profit, quantity, margin, tier colour,
    sales clipped at 1 for a log axis, drawing order by quantity (M4, M11, K8)."""
    a, _ = rule_tiers(spark, sf_dir)
    w = Window.partitionBy("branch").orderBy(F.desc("Qty"), "Product")
    return a.select("branch", "Product", "SuccessTier", tier_colour(F.col("SuccessTier")).alias("TierColor"),
                    rm("Sales").alias("Sales"), rm("Profit").alias("Profit"), rm("Qty").alias("Qty"),
                    r6("MarginPct").alias("MarginPct"), r6(F.greatest(F.col("Sales"), F.lit(1.0))).alias("SalesForPlot"),
                    F.row_number().over(w).cast("bigint").alias("draw_order"))


@register("q_combined_view", with_items(f"""
, g AS (SELECT Cluster, SUM(total_sales) AS s FROM prof GROUP BY Cluster)
, gs AS (SELECT Cluster, s / (SELECT SUM(s) FROM g) AS sales_share FROM g)
SELECT branch, Cluster, SuccessRank, {R6("sales_share")} AS sales_share FROM prof
UNION ALL
SELECT '{ALL_BRANCHES_LABEL}', Cluster, DENSE_RANK() OVER (ORDER BY ROUND(sales_share, 12) DESC),
       {R6("sales_share")} FROM gs""", *RULE_CTES))
def q_combined_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-branch tiers plus the combined pseudo-branch whose rank is the
    dense rank of its global sales share (M18, H1, I12, C6)."""
    _, prof = rule_tiers(spark, sf_dir)
    g = prof.groupBy("Cluster").agg(F.sum("total_sales").alias("s"))
    tot = g.select(F.sum("s")).scalar()
    gs = g.select("Cluster", (F.col("s") / tot).alias("sales_share"))
    gs = gs.select(F.lit(ALL_BRANCHES_LABEL).alias("branch"), "Cluster",
                   F.dense_rank().over(Window.orderBy(F.desc(F.round("sales_share", 12)))).cast("bigint")
                   .alias("SuccessRank"), r6("sales_share").alias("sales_share"))
    per = prof.select("branch", "Cluster", F.col("SuccessRank").cast("bigint").alias("SuccessRank"),
                      r6("sales_share").alias("sales_share"))
    return per.unionByName(gs)


def _fmt_table(df: DataFrame, name: str) -> DataFrame:
    """Display formatting: thousands separators without decimals, percent
    with one decimal (K14)."""
    return df.select(F.lit(name).alias("table"), "branch", "rank", "Product", "SuccessTier", "Cluster",
                     F.format_number("Sales", 0).alias("Sales"), F.format_number("Profit", 0).alias("Profit"),
                     F.format_string("%.1f%%", F.col("MarginPct") * 100).alias("MarginPct"),
                     F.format_number("Qty", 0).alias("Qty"))


def _fmt_sql(name: str, src: str) -> str:
    return (f"SELECT '{name}' AS \"table\", branch, rank, Product, SuccessTier, Cluster, "
            f"format('{{:,.0f}}', Sales) AS Sales, format('{{:,.0f}}', Profit) AS Profit, "
            f"printf('%.1f%%', MarginPct * 100) AS MarginPct, format('{{:,.0f}}', Qty) AS Qty FROM {src}")


@register("q_tier_tables", with_items(f"""
, worst AS (SELECT branch, MAX(SuccessRank) AS wr FROM asg GROUP BY branch)
, t1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY Sales DESC, Product) AS rank FROM asg
         WHERE SuccessRank = 1)
, t2 AS (SELECT a.*, ROW_NUMBER() OVER (PARTITION BY a.branch ORDER BY Sales, Profit, Product) AS rank
         FROM asg a JOIN worst w ON a.branch = w.branch WHERE a.SuccessRank = w.wr)
, t3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY Sales DESC, Product) AS rank FROM asg)
, t4 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY Sales, Product) AS rank FROM asg)
{_fmt_sql("top_tier", "t1 WHERE rank <= 10")} UNION ALL
{_fmt_sql("least_success", "t2 WHERE rank <= 10")} UNION ALL
{_fmt_sql("top_sales", "t3 WHERE rank <= 10")} UNION ALL
{_fmt_sql("bottom_sales", "t4 WHERE rank <= 10")}""", *RULE_CTES))
def q_tier_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four dashboard tables per branch - best tier top 10, least
    successful tier bottom 10 by (Sales, Profit), top 10 and bottom 10 by
    sales - with display formatting (M16, I5, D19f, K14)."""
    a, _ = rule_tiers(spark, sf_dir)
    wr = a.groupBy("branch").agg(F.max("SuccessRank").alias("_wr"))
    least = a.join(wr, "branch").filter(F.col("SuccessRank") == F.col("_wr")).drop("_wr")
    parts = [
        _fmt_table(_ranked(a, [F.desc("Sales"), "Product"], 10, F.col("SuccessRank") == 1), "top_tier"),
        _fmt_table(_ranked(least, ["Sales", "Profit", "Product"], 10), "least_success"),
        _fmt_table(_ranked(a, [F.desc("Sales"), "Product"], 10), "top_sales"),
        _fmt_table(_ranked(a, ["Sales", "Product"], 10), "bottom_sales"),
    ]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


@register("q_branch_list", with_items(f"""
SELECT branch, ROW_NUMBER() OVER (ORDER BY branch <> '{ALL_BRANCHES_LABEL}', branch) AS position FROM (
  SELECT DISTINCT TRIM(branch) AS branch FROM asg UNION SELECT '{ALL_BRANCHES_LABEL}')""", *RULE_CTES))
def q_branch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch selector: the combined label first, then the distinct trimmed
    branch names in order (I13, C6); one row per branch, so the global order
    is over a bounded list."""
    a, _ = rule_tiers(spark, sf_dir)
    b = a.select(F.trim("branch").alias("branch")).distinct().unionByName(
        spark.range(1).select(F.lit(ALL_BRANCHES_LABEL).alias("branch"))).distinct()
    w = Window.orderBy(F.col("branch") != ALL_BRANCHES_LABEL, "branch")
    return b.select("branch", F.row_number().over(w).cast("bigint").alias("position"))
