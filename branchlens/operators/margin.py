"""Margin aggregation (G1, G2, G6), branch x department feature pivots.

All aggregations are single ``groupBy`` plans (partial + final hash aggregate,
one shuffle on the grouping keys); pivots are conditional sums inside the same
aggregate with an explicit value list, so no extra job discovers the values.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import guarded_ratio, zero_sum

DEPARTMENTS = ("TABLE", "TAKE AWAY", "Toters")
METRICS = ("Sales", "Cost", "Profit", "Qty", "GM_pct")


def aggregate_margin(df: DataFrame, keys: Sequence[str], price: str = "price", cost: str = "cost",
                     profit: str = "profit", qty: str = "qty") -> DataFrame:
    """Sales / COGS / GM / Qty per key with GM_pct = GM / Sales (null when
    Sales is 0). Null keys are kept as their own group; an all-null metric sums
    to 0. Empty input gives an empty frame with the same schema."""
    return (df.groupBy(*keys)
            .agg(zero_sum(price).alias("Sales"), zero_sum(cost).alias("COGS"),
                 zero_sum(profit).alias("GM"), zero_sum(qty).alias("Qty"))
            .withColumn("GM_pct", guarded_ratio(F.col("GM"), F.col("Sales"), nonzero=True)))


def pivot_sum(value: Column | str, key: str, values: Iterable[str], prefix: str) -> list[Column]:
    """Conditional sums ``sum(value) where key = v`` for an explicit value list
    (the shape of ``pivot``/``unstack(fill_value=0)`` without a discovery job)."""
    v = F.col(value) if isinstance(value, str) else value
    return [F.coalesce(F.sum(F.when(F.col(key) == x, v)), F.lit(0.0)).alias(f"{prefix}{x}")
            for x in values]


def branch_department_features(items: DataFrame, departments: Sequence[str] = DEPARTMENTS,
                               branch: str = "branch", department: str = "department") -> DataFrame:
    """One wide row per branch: {Sales, Cost, Profit, Qty, GM_pct}_<dept>.

    A department the branch does not have yields NULL (pandas pivot gives NaN),
    which downstream feature code fills explicitly."""
    aggs = []
    for d in departments:
        in_d = F.col(department) == d
        aggs += [
            F.sum(F.when(in_d, F.col("price"))).alias(f"Sales_{d}"),
            F.sum(F.when(in_d, F.col("cost"))).alias(f"Cost_{d}"),
            F.sum(F.when(in_d, F.col("profit"))).alias(f"Profit_{d}"),
            F.sum(F.when(in_d, F.col("qty"))).alias(f"Qty_{d}"),
        ]
    wide = items.groupBy(branch).agg(*aggs)
    return wide.select(branch, *[c for d in departments for c in (
        f"Sales_{d}", f"Cost_{d}", f"Profit_{d}", f"Qty_{d}")], *[
        guarded_ratio(F.col(f"Profit_{d}"), F.col(f"Sales_{d}"), nonzero=True).alias(f"GM_pct_{d}")
        for d in departments])
