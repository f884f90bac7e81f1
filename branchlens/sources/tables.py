"""Driver tables and the retail ``items`` view built on them.

The reference consumes POS report facts (branch, department, category,
division, product, qty, price, cost, profit). Those files are not shipped, so
every query runs on the star-schema test tables through one lazy view whose
mapping is fixed below. The view is a plain DataFrame plan: Catalyst prunes
the columns each query needs down to the Parquet scans and pushes filters.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the retail mapping (department per return flag, channel
# availability rules, cost factor).
DEPARTMENT_BY_FLAG = {"A": "TABLE", "N": "TAKE AWAY", "R": "Toters"}
DEPARTMENTS = ("TABLE", "TAKE AWAY", "Toters")
TOTERS_NATION_MODULUS = 4      # Toters only where n_nationkey % 4 = 0; elsewhere those lines are sold at the table
NO_TAKEAWAY_NATION = 7         # one branch without take-away sells those lines at the table too
COST_FACTOR = 0.3              # cost = qty * retail price * 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def department_expr(flag: Column, nation: Column) -> Column:
    """The channel of a line; a branch without the line's channel sold it at the
    table, so no line is left out."""
    closed = (((flag == "N") & (nation == NO_TAKEAWAY_NATION))
              | ((flag == "R") & (nation % TOTERS_NATION_MODULUS != 0)))
    out = F.when(closed, F.lit(DEPARTMENTS[0]))
    for k, v in DEPARTMENT_BY_FLAG.items():
        out = out.when(flag == k, F.lit(v))
    return out


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sold line, in the reference's fact vocabulary.

    Join order is chosen so that the big fact table is shuffled once on the
    order key: orders -> customer -> nation is resolved first (order-sized),
    then joined to lineitem; ``part`` and ``nation`` are left to Spark's
    size-checked broadcast (autoBroadcastJoinThreshold / AQE)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")

    order_branch = (od.join(cu, od.o_custkey == cu.c_custkey)
                    .join(na, cu.c_nationkey == na.n_nationkey)
                    .select("o_orderkey", "o_orderdate", "n_nationkey", "n_name"))
    j = li.join(order_branch, li.l_orderkey == order_branch.o_orderkey).join(
        pa, li.l_partkey == pa.p_partkey)
    price = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    cost = F.col("l_quantity") * F.col("p_retailprice") * F.lit(COST_FACTOR)
    return j.select(
        F.col("n_name").alias("branch"),
        department_expr(F.col("l_returnflag"), F.col("n_nationkey")).alias("department"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product"),
        F.concat_ws(" ", "p_brand", "p_type").alias("family"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("division"),
        F.col("p_name").alias("grp"),
        F.col("l_quantity").alias("qty"),
        price.alias("price"),
        cost.alias("cost"),
        (price - cost).alias("profit"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    )


# The same view for the DuckDB oracle (tables are pre-registered views).
ITEMS_SQL = """
items AS (
  SELECT n.n_name AS branch,
         CASE WHEN l.l_returnflag = 'A' OR (l.l_returnflag = 'N' AND n.n_nationkey = 7)
                OR (l.l_returnflag = 'R' AND n.n_nationkey % 4 <> 0) THEN 'TABLE'
              WHEN l.l_returnflag = 'N' THEN 'TAKE AWAY' WHEN l.l_returnflag = 'R' THEN 'Toters' END AS department,
         'P' || CAST(l.l_partkey AS VARCHAR) AS product,
         p.p_brand || ' ' || p.p_type AS family,
         p.p_type AS category, p.p_brand AS division, p.p_name AS grp,
         l.l_quantity AS qty,
         l.l_extendedprice * (1.0 - l.l_discount) AS price,
         l.l_quantity * p.p_retailprice * CAST(0.3 AS DOUBLE) AS cost,
         l.l_extendedprice * (1.0 - l.l_discount) - l.l_quantity * p.p_retailprice * CAST(0.3 AS DOUBLE) AS profit,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(month(o.o_orderdate) AS INTEGER) AS month
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def with_items(sql_body: str, *extra_ctes: str) -> str:
    """Prefix an oracle query with the items CTE (and more CTEs)."""
    ctes = [ITEMS_SQL.strip()] + [c.strip() for c in extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + sql_body
