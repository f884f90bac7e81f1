"""Cluster profiles, labels, success tiers.

Profiles are one ``groupBy`` per (group, cluster); statistics *across* a
group's clusters (quantiles, z-scores, ranks) run over the profile table,
which has at most k_max rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantiles import group_quantiles

# Cluster labels and actions (global clustering, first match wins).
LABEL_CORE = ("Core Winners", "Protect availability, bundle with add-ons, and prioritize in promotions.")
LABEL_TAKEAWAY = ("Takeaway Niche", "Keep only in demand branches and test targeted takeaway campaigns.")
LABEL_TOTERS = ("Toters-Leaning", "Optimize delivery packaging and run delivery-only bundles.")
LABEL_MARGIN = ("Margin Risk", "Review recipe cost and pricing before scaling.")
LABEL_GROWTH = ("Growth Mid-Tier", "Expand selectively and pair with high-margin complements.")
TAKEAWAY_NICHE_SHARE = 0.90

# Success tier names and actions (per-branch clustering).
TIER_MOST = ("Most Successful", "Protect availability and prioritize this tier for bundles and promo visibility.")
TIER_LEAST = ("Least Successful", "Review pricing, recipe cost, and demand; consider redesign or delisting weak SKUs.")
TIER_STRONG = ("Strong", "Invest in upselling and selective promotions to push this tier toward top performance.")
TIER_MID = ("Mid/Low", "Improve placement and offer pairing tests; monitor profit lift before scaling.")
SUCCESS_WEIGHTS = (0.50, 0.35, 0.15)   # z(median sales), z(median profit), z(median margin)
TOP_PRODUCTS_N = 8


def profiles(assign: DataFrame, group: Sequence[str], product: str = "Product",
             per_branch: bool = False) -> DataFrame:
    """Cluster profile rows (G7) with sales/profit share of the group total."""
    g = list(group)
    medians = {"Sales": "median_sales", "Profit": "median_profit", "MarginPct": "median_margin_pct",
               "AvgPrice": "median_avg_price"}
    aggs = [F.count(F.col(product)).alias("n_products"),
            F.sum("Sales").alias("total_sales"), F.sum("Profit").alias("total_profit")]
    if per_branch:
        medians |= {"SalesShareInBranch": "median_sales_share_in_branch",
                    "ProfitShareInBranch": "median_profit_share_in_branch"}
    else:
        aggs += [F.avg("BranchPenetration").alias("avg_branch_penetration")]
    aggs += [F.avg("TakeAwayShare").alias("avg_takeaway_share"), F.avg("TableShare").alias("avg_table_share"),
             F.avg("TotersShare").alias("avg_toters_share")]
    assign = cut_lineage(assign)
    mid = group_quantiles(assign, [*g, "Cluster"], list(medians), [0.5])
    mid = mid.select(*g, "Cluster", *[F.col(f"{c}_q")[0].alias(n) for c, n in medians.items()])
    prof = assign.groupBy(*g, "Cluster").agg(*aggs).join(mid, [*g, "Cluster"])
    tot = prof.groupBy(*g).agg(F.sum("total_sales").alias("_ts"), F.sum("total_profit").alias("_tp"))
    return (prof.join(tot, g)
            .withColumn("sales_share", F.when(F.col("_ts") > 0, F.col("total_sales") / F.col("_ts")).otherwise(0.0))
            .withColumn("profit_share",
                        F.when(F.col("_tp") != 0, F.col("total_profit") / F.col("_tp")).otherwise(0.0))
            .drop("_ts", "_tp"))


def label_clusters(prof: DataFrame, group: Sequence[str]) -> DataFrame:
    """ClusterLabel / SuggestedAction by ordered rules on quantiles of the
    profile table (G9, K16), which has one row per cluster."""
    g = list(group)
    q = prof.groupBy(*g).agg(
        F.percentile("median_sales", 0.75).alias("sales_q75"),
        F.percentile("avg_branch_penetration", 0.75).alias("branch_q75"),
        F.percentile("avg_branch_penetration", 0.50).alias("branch_q50"),
        F.percentile("avg_toters_share", 0.75).alias("toters_q75"),
        F.percentile("median_margin_pct", 0.25).alias("margin_q25"))
    p = prof.join(q, g)
    rules = [
        ((F.col("median_sales") >= F.col("sales_q75")) & (F.col("avg_branch_penetration") >= F.col("branch_q75")),
         LABEL_CORE),
        ((F.col("avg_takeaway_share") >= TAKEAWAY_NICHE_SHARE)
         & (F.col("avg_branch_penetration") <= F.col("branch_q50")), LABEL_TAKEAWAY),
        (F.col("avg_toters_share") >= F.col("toters_q75"), LABEL_TOTERS),
        (F.col("median_margin_pct") <= F.col("margin_q25"), LABEL_MARGIN),
    ]
    name = _first_match(rules, 0, LABEL_GROWTH[0])
    action = _first_match(rules, 1, LABEL_GROWTH[1])
    return (p.withColumn("ClusterLabel", F.concat(F.lit("C"), F.col("Cluster").cast("string"), F.lit(": "), name))
            .withColumn("SuggestedAction", action)
            .drop("sales_q75", "branch_q75", "branch_q50", "toters_q75", "margin_q25"))


def _first_match(rules, idx: int, default: str) -> Column:
    out = None
    for cond, vals in rules:
        c = F.coalesce(cond, F.lit(False))
        out = F.when(c, F.lit(vals[idx])) if out is None else out.when(c, F.lit(vals[idx]))
    return out.otherwise(F.lit(default))


def zscore(c: str, group: Sequence[str]) -> Column:
    """(x - mean) / population std over the group's rows; std 0 or NULL -> 0 (H3)."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(c).over(w)
    return F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise((F.col(c) - F.avg(c).over(w)) / sd)


def success_tiers(prof: DataFrame, group: Sequence[str]) -> DataFrame:
    """SuccessScore (H4), SuccessRank = row number by score desc, cluster
    as tie-break (H2), tier name and action (K15)."""
    g = list(group)
    a, b, c = SUCCESS_WEIGHTS
    p = prof.withColumn("SuccessScore", F.lit(a) * zscore("median_sales", g) + F.lit(b) * zscore("median_profit", g)
                        + F.lit(c) * zscore("median_margin_pct", g))
    w = Window.partitionBy(*g).orderBy(F.desc_nulls_last("SuccessScore"), "Cluster")
    p = (p.withColumn("SuccessRank", F.row_number().over(w))
         .withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy(*g))))
    rank, total = F.col("SuccessRank"), F.col("_total")
    mid = rank <= F.greatest(F.lit(2), F.floor(total / 2))
    name = (F.when(rank == 1, F.lit(TIER_MOST[0])).when(rank == total, F.lit(TIER_LEAST[0]))
            .when(mid, F.lit(TIER_STRONG[0])).otherwise(F.lit(TIER_MID[0])))
    action = (F.when(rank == 1, F.lit(TIER_MOST[1])).when(rank == total, F.lit(TIER_LEAST[1]))
              .when(mid, F.lit(TIER_STRONG[1])).otherwise(F.lit(TIER_MID[1])))
    return (p.withColumn("SuccessTier", F.concat(F.lit("Tier "), rank.cast("string"), F.lit(": "), name))
            .withColumn("SuggestedAction", action).drop("_total"))


def top_products(assign: DataFrame, group: Sequence[str], product: str = "Product",
                 n: int = TOP_PRODUCTS_N) -> DataFrame:
    """'; '-joined top-n products by sales per (group, cluster) (G10); the
    per-cluster limit is applied before anything is collected."""
    g = list(group)
    w = Window.partitionBy(*g, "Cluster").orderBy(F.desc("Sales"), product)
    top = assign.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return (top.groupBy(*g, "Cluster")
            .agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(product).alias("p")))).alias("_s"))
            .select(*g, "Cluster", F.array_join(F.transform("_s", lambda e: e["p"]), "; ").alias("TopProducts")))
