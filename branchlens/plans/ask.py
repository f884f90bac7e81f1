"""The dashboard's canned questions as parameterised SQL table functions (D14f, M17):
a branch and a number of rows are arguments, the combined pseudo-branch is one of
the branches (M1, M18, D20f). ``ask_functions`` registers them in the session over
one materialised table of tiered products; a question is then one call, such as
``SELECT * FROM ask_top_products('NATION_4', 5)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import r6, rm
from ..session import cut_lineage
from ..sources.tables import with_items
from .dashboard import ALL_BRANCHES_LABEL, RULE_CTES, rule_tiers
from .registry import register
from .sqlparts import R6

VIEW = "branchlens_products"

_COLUMNS = "branch STRING, rank INT, Product STRING, Sales DOUBLE, Profit DOUBLE, MarginPct DOUBLE"


def _ranked(name: str, order: str, where: str = "true") -> str:
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(of_branch STRING, top INT) RETURNS TABLE({_COLUMNS})
RETURN SELECT branch, rank, Product, Sales, Profit, MarginPct FROM (
  SELECT *, row_number() OVER (ORDER BY {order}, Product) AS rank FROM {VIEW} WHERE branch = of_branch AND {where})
WHERE rank <= top"""


#: Name -> order and condition of a ranked question.
QUESTIONS = {
    "ask_top_products": ("Sales DESC", "true"),
    "ask_bottom_products": ("Sales", "true"),
    "ask_low_margin": ("MarginPct ASC NULLS LAST", "true"),
    "ask_loss_makers": ("Profit", "Profit < 0"),
    "ask_best_tier": ("Sales DESC", "SuccessRank = 1"),
}

_CARD = f"""CREATE OR REPLACE TEMPORARY FUNCTION ask_branch_card(of_branch STRING)
RETURNS TABLE(branch STRING, products BIGINT, sales DOUBLE, profit DOUBLE, margin DOUBLE, loss_makers BIGINT, best_tier STRING)
RETURN SELECT branch, count(*), sum(Sales), sum(Profit), try_divide(sum(Profit), sum(Sales)), count_if(Profit < 0),
  min(SuccessTier) FILTER (WHERE SuccessRank = 1) FROM {VIEW} WHERE branch = of_branch GROUP BY branch"""

_CHANNELS = f"""CREATE OR REPLACE TEMPORARY FUNCTION ask_channel(of_branch STRING, channel STRING)
RETURNS TABLE(branch STRING, channel STRING, leader STRING, share DOUBLE)
RETURN SELECT branch, ch, SuccessTier, v FROM (
  SELECT *, row_number() OVER (PARTITION BY ch ORDER BY v DESC, rk) AS rn FROM (
    SELECT branch, SuccessTier, rk, stack(3, 'Take Away', ta, 'Table', tb, 'Toters', tt) AS (ch, v) FROM (
      SELECT branch, SuccessTier, min(SuccessRank) AS rk, avg(TakeAwayShare) AS ta, avg(TableShare) AS tb, avg(TotersShare) AS tt
      FROM {VIEW} WHERE branch = of_branch GROUP BY branch, SuccessTier)) WHERE ch = channel) WHERE rn = 1"""


def combined(products: DataFrame) -> DataFrame:
    """Rows of the combined pseudo-branch: every product over all branches, shares
    weighted by sales, tiers by the dense rank of their sales (M18, H1)."""
    shares = [(F.sum(F.col(c) * F.col("Sales")) / F.sum("Sales")).alias(c) for c in ("TakeAwayShare", "TableShare", "TotersShare")]
    g = products.groupBy("Product", "Cluster").agg(F.sum("Sales").alias("Sales"), F.sum("Profit").alias("Profit"), *shares)
    rank = products.groupBy("Cluster").agg(F.sum("Sales").alias("s"))
    better = rank.select(F.sort_array(F.collect_list(F.round("s", 4)), asc=False)).scalar()     # one number a cluster
    rank = rank.select("Cluster", F.array_position(better, F.round("s", 4)).cast("int").alias("SuccessRank"))
    return g.join(rank, "Cluster").select(
        F.lit(ALL_BRANCHES_LABEL).alias("branch"), "Product", "Sales", "Profit", F.try_divide("Profit", "Sales").alias("MarginPct"),
        "TakeAwayShare", "TableShare", "TotersShare", "SuccessRank",
        F.concat(F.lit("Tier "), F.col("SuccessRank").cast("string")).alias("SuccessTier"))


def ask_functions(spark: SparkSession, products: DataFrame) -> None:
    """Register every question over ``products``: a tiered assignments table
    (branch, Product, Cluster, Sales, Profit, shares, SuccessRank, SuccessTier)."""
    cols = ["branch", "Product", "Sales", "Profit", "MarginPct", "TakeAwayShare", "TableShare", "TotersShare",
            "SuccessRank", "SuccessTier"]
    table = cut_lineage(products)
    every = table.select(*cols).unionByName(combined(table))
    cut_lineage(every).createOrReplaceTempView(VIEW)
    for name, (order, where) in QUESTIONS.items():
        spark.sql(_ranked(name, order, where))
    spark.sql(_CARD)
    spark.sql(_CHANNELS)


#: Arguments of the registered calls.
BRANCH, N = "NATION_4", 7
PRODUCTS_CTE = f"""every AS (
  SELECT branch, Product, Sales, Profit, MarginPct, TakeAwayShare, TableShare, TotersShare, SuccessRank, SuccessTier FROM asg
  UNION ALL SELECT '{ALL_BRANCHES_LABEL}', Product, s, p, p / s, ta / s, tb / s, tt / s, rk, 'Tier ' || rk FROM (
    SELECT Product, Cluster, SUM(Sales) AS s, SUM(Profit) AS p, SUM(TakeAwayShare * Sales) AS ta, SUM(TableShare * Sales) AS tb,
           SUM(TotersShare * Sales) AS tt FROM asg GROUP BY ALL) g
  JOIN (SELECT Cluster, RANK() OVER (ORDER BY ROUND(SUM(Sales), 4) DESC) AS rk FROM asg GROUP BY Cluster) r ON g.Cluster = r.Cluster)"""


def _call(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    ask_functions(spark, rule_tiers(spark, sf_dir)[0])
    return spark.sql(" UNION ALL ".join(sql.format(b=b, n=N) for b in (BRANCH, ALL_BRANCHES_LABEL)))


def _register(name: str, order: str, where: str) -> None:
    @register(f"q_{name}", with_items(f"""
SELECT branch, CAST(rank AS INTEGER) AS rank, Product, ROUND(Sales, 4) AS Sales, ROUND(Profit, 4) AS Profit,
       {R6("MarginPct")} AS MarginPct FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY {order}, Product) AS rank FROM every
  WHERE branch IN ('{BRANCH}', '{ALL_BRANCHES_LABEL}') AND {where}) WHERE rank <= {N}""", *RULE_CTES, PRODUCTS_CTE))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = _call(spark, sf_dir, f"SELECT * FROM {name}('{{b}}', {{n}})")
        return got.select("branch", "rank", "Product", rm("Sales").alias("Sales"), rm("Profit").alias("Profit"),
                          r6("MarginPct").alias("MarginPct"))
    query.__doc__ = f"``{name}`` for one branch and the combined one (D14f, M1, M17, M18)."


for _name, (_order, _where) in QUESTIONS.items():
    _register(_name, _order, _where)


@register("q_ask_branch_card", with_items(f"""
SELECT branch, COUNT(*) AS products, ROUND(SUM(Sales), 4) AS sales, ROUND(SUM(Profit), 4) AS profit,
       {R6("SUM(Profit) / SUM(Sales)")} AS margin, COUNT(*) FILTER (WHERE Profit < 0) AS loss_makers,
       MIN(SuccessTier) FILTER (WHERE SuccessRank = 1) AS best_tier
FROM every WHERE branch IN ('{BRANCH}', '{ALL_BRANCHES_LABEL}') GROUP BY branch""", *RULE_CTES, PRODUCTS_CTE))
def q_ask_branch_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary card of one branch and the combined one (M1, M2, D14f)."""
    got = _call(spark, sf_dir, "SELECT * FROM ask_branch_card('{b}')")
    return got.select("branch", "products", rm("sales").alias("sales"), rm("profit").alias("profit"), r6("margin").alias("margin"),
                      "loss_makers", "best_tier")


@register("q_ask_channel", with_items(f"""
, t AS (SELECT branch, SuccessTier, MIN(SuccessRank) AS rk, AVG(TakeAwayShare) AS v FROM every
        WHERE branch IN ('{BRANCH}', '{ALL_BRANCHES_LABEL}') GROUP BY ALL)
SELECT branch, 'Take Away' AS channel, SuccessTier AS leader, {R6("v")} AS share FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY v DESC, rk) AS rn FROM t) WHERE rn = 1""", *RULE_CTES, PRODUCTS_CTE))
def q_ask_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier with the highest mean share of a channel."""
    got = _call(spark, sf_dir, "SELECT * FROM ask_channel('{b}', 'Take Away')")
    return got.select("branch", "channel", "leader", r6("share").alias("share"))
