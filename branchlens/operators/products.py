"""Product tables (G3-G6, J3, C8-C10, F1-F3, C9) and per-branch shares.

The reference builds a product rollup, a separate channel ``unstack`` and
merges them; here both are one ``groupBy`` with conditional sums. Branch
totals are an aggregate joined back on the branch key (the totals frame has
one row per branch, so AQE turns the join into a broadcast after measuring
it) rather than a window, which would send each branch to a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, guarded_ratio, log1p_clip0, zero_sum
from ..session import cut_lineage
from .margin import DEPARTMENTS

GLOBAL_FEATURES = ["log_Sales", "MarginPct", "log_AvgPrice", "BranchPenetration",
                   "TakeAwayShare", "TableShare", "TotersShare"]
BRANCH_FEATURES = ["log_Sales", "MarginPct", "log_AvgPrice", "SalesShareInBranch",
                   "ProfitShareInBranch", "TakeAwayShare", "TableShare", "TotersShare"]


def _as_product(items: DataFrame, product: str) -> DataFrame:
    """Expose the chosen product grain as ``Product`` (column names are
    case-insensitive, so another ``product`` column is dropped first)."""
    if product.lower() != "product":
        items = items.drop("product")
    return items.withColumnRenamed(product, "Product")


def _base(items: DataFrame) -> DataFrame:
    """The only pass over the facts: one partial+final aggregate to
    (branch, Product, category, division) with row counts, sums and channel
    sums. Every product-level number (sums, distinct branches, modes, the branch
    count) is derived from it; its size is bounded by catalog x branches, not by
    the number of sales lines."""
    chan = [F.sum(F.when(F.col("department") == d, F.col("price"))).alias(d) for d in DEPARTMENTS]
    return items.groupBy("branch", "Product", "category", "division").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("price").alias("Sales"), F.sum("cost").alias("Cost"),
        F.sum("profit").alias("Profit"), F.sum("qty").alias("Qty"), *chan)


def _null_safe_left(t: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` in which a null key matches a null key."""
    r = other.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return t.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])


def _rollup(base: DataFrame, keys: Sequence[str], extra=()) -> DataFrame:
    """Sums per key, and Category / Division as mode_or_first: the most frequent
    non-null value (row counts of the base aggregate), smallest on ties (G5). The
    base is dealt once by ``keys``; counts per value and the sums need no other
    shuffle and no join."""
    sums = [zero_sum(c).alias(c) for c in ("Sales", "Cost", "Profit", "Qty")]
    chan = [F.coalesce(F.sum(F.col(f"`{d}`")), F.lit(0.0)).alias(d) for d in DEPARTMENTS]
    values = {"Category": "category", "Division": "division"}
    counted = base.repartition(*keys).withColumns({
        f"_n_{c}": F.sum("_n").over(Window.partitionBy(*keys, c)) for c in values.values()})
    modes = [F.min(F.when(F.col(c).isNotNull(), F.struct(-F.col(f"_n_{c}"), F.col(c).alias("v")))).getField("v").alias(alias)
             for alias, c in values.items()]
    t = counted.groupBy(*keys).agg(*sums, *extra, *chan, *modes)
    return t.select(*keys, "Category", "Division", *[c for c in t.columns
                                                     if c not in (*keys, "Category", "Division")])


def _ratios(df: DataFrame) -> DataFrame:
    return (df
            .withColumn("MarginPct", guarded_ratio(F.col("Profit"), F.col("Sales")))
            .withColumn("AvgPrice", guarded_ratio(F.col("Sales"), F.col("Qty")))
            .withColumn("TableShare", guarded_ratio(F.col("TABLE"), F.col("Sales"), 0.0))
            .withColumn("TakeAwayShare", guarded_ratio(F.col("`TAKE AWAY`"), F.col("Sales"), 0.0))
            .withColumn("TotersShare", guarded_ratio(F.col("Toters"), F.col("Sales"), 0.0)))


def product_table(items: DataFrame, product: str = "product") -> DataFrame:
    """One row per product over all branches.

    ``BranchPenetration`` = distinct branches of the product / distinct
    branches overall; the denominator is a scalar subquery (no cross join)."""
    base = cut_lineage(_base(_as_product(items, product)))
    n_branches = base.select(F.count_distinct("branch")).scalar()
    t = _rollup(base, ["Product"], extra=[F.count_distinct("branch").alias("Branches")])
    t = _ratios(t).withColumn("BranchPenetration", F.col("Branches") / n_branches)
    return (t.withColumn("log_Sales", log1p_clip0("Sales"))
            .withColumn("log_AvgPrice", log1p_clip0("AvgPrice")))


def branch_product_table(items: DataFrame, product: str = "product") -> DataFrame:
    """One row per (branch, product) with in-branch shares."""
    t = _ratios(cut_lineage(_rollup(_base(_as_product(items, product)), ["branch", "Product"])))
    # a row a branch, of known size, so that the products are joined to it without a shuffle
    totals = cut_lineage(t.groupBy("branch").agg(
        F.sum("Sales").alias("BranchSales"),
        F.sum(F.greatest(F.col("Profit"), F.lit(0.0))).alias("BranchPositiveProfit")))
    t = _null_safe_left(t, totals, ["branch"])
    return (t
            .withColumn("SalesShareInBranch", guarded_ratio(F.col("Sales"), F.col("BranchSales"), 0.0))
            .withColumn("ProfitShareInBranch",
                        guarded_ratio(clip("Profit", 0.0), F.col("BranchPositiveProfit"), 0.0))
            .withColumn("log_Sales", log1p_clip0("Sales"))
            .withColumn("log_AvgPrice", log1p_clip0("AvgPrice")))


def with_global_shares(assign: DataFrame) -> DataFrame:
    """SalesShare / ProfitShare of the global total (G8: ``> 0`` resp.
    ``!= 0`` guards), totals as scalar subqueries."""
    ts = assign.select(F.sum("Sales")).scalar()
    tp = assign.select(F.sum("Profit")).scalar()
    return (assign.withColumn("SalesShare", F.when(ts > 0, F.col("Sales") / ts).otherwise(F.lit(0.0)))
            .withColumn("ProfitShare", F.when(tp != 0, F.col("Profit") / tp).otherwise(F.lit(0.0))))
