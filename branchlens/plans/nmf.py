"""Branch product-mix queries: group revenue shares (G15, J4, K18, D9f, F4),
NMF (L25-L27) and the pattern read-outs (H13-H16, K17). The factorisation
fits every K and start of the sparse shares together (``operators.nmf``).

The read-out operators are SQL-checked on the share matrix itself (each
product group is its own "pattern"); on the NMF weights they run in
``q_nmf_branch_patterns`` (rows-only, iterative fit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6, rm
from ..operators import nmf
from ..session import cut_lineage
from ..sources.tables import items, with_items
from .registry import register
from .sqlparts import R6

NMF_K = 6                      # as in the reference's final run
K_RANGE = range(2, 11)         # the reference's sweep
STARTS = 8
MAX_ITER = 60                  # fits end when no error falls by 0.1 % in five iterations
TOL = 1e-3
TOP_BRANCHES = 5
TOP_GROUPS = 7

SHARES_CTE = """sh AS (
  SELECT g.branch, g.grp, g.TotalAmount, t.branch_total, g.TotalAmount / t.branch_total AS rev_share
  FROM (SELECT branch, grp, SUM(price) AS TotalAmount FROM items WHERE branch IS NOT NULL AND price IS NOT NULL
        GROUP BY branch, grp) g
  JOIN (SELECT branch, SUM(price) AS branch_total FROM items WHERE branch IS NOT NULL AND price IS NOT NULL
        GROUP BY branch) t ON g.branch = t.branch)"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nmf.group_shares(items(spark, sf_dir))


@register("q_group_share_long", with_items(f"""
SELECT branch, grp, ROUND(TotalAmount, 4) AS TotalAmount, ROUND(branch_total, 4) AS branch_total,
       {R6("rev_share", 9)} AS rev_share FROM sh""", SHARES_CTE))
def q_group_share_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per (branch, product group) and its share of the branch."""
    s = shares(spark, sf_dir)
    return s.select("branch", "grp", rm("TotalAmount").alias("TotalAmount"), rm("branch_total").alias("branch_total"),
                    r6("rev_share", 9).alias("rev_share"))


@register("q_group_share_matrix", with_items(f"""
SELECT b.branch, 'revshare_group__' || TRIM(g.grp) AS feature, COALESCE({R6("sh.rev_share", 9)}, 0) AS share
FROM (SELECT DISTINCT branch FROM sh WHERE grp IS NOT NULL) b
CROSS JOIN (SELECT DISTINCT grp FROM sh WHERE grp IS NOT NULL) g
LEFT JOIN sh ON sh.branch = b.branch AND sh.grp = g.grp""", SHARES_CTE))
def q_group_share_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NMF input, one row per matrix cell: branch, ``revshare_group__<group>``
    and the share, 0 where the branch did not sell the group (J4). The columns
    are the distinct groups of the aggregated shares, a scalar subquery; a
    NULL group counts in the branch total but gets no column."""
    s = shares(spark, sf_dir).filter(F.col("grp").isNotNull())
    groups = s.select(F.sort_array(F.collect_set("grp"))).scalar()
    cells = s.select("branch").distinct().select("branch", F.explode(groups).alias("grp"))
    return cells.join(s, ["branch", "grp"], "left").select(
        "branch", F.concat(F.lit("revshare_group__"), F.trim("grp")).alias("feature"),
        F.coalesce(r6("rev_share", 9), F.lit(0.0)).alias("share"))


def _x_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shares(spark, sf_dir).filter(F.col("grp").isNotNull())
    return nmf.l1_normalise(s.select("branch", "grp", F.col("rev_share").alias("x")), "branch", "x")


def _fit(spark: SparkSession, sf_dir: str, ks):
    return nmf.fit_nmf(_x_long(spark, sf_dir), "branch", "grp", "x", ks, STARTS, MAX_ITER, TOL)


@register("q_nmf_fit")
def q_nmf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch pattern weights W of a K=6 non-negative factorisation of the
    branch x group share matrix, best of 8 starts (L25)."""
    w, _, _ = _fit(spark, sf_dir, [NMF_K])
    return w.select("branch", "pattern", "weight")


@register("q_nmf_patterns")
def q_nmf_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern definitions: top-7 product groups of every H row."""
    _, h, _ = _fit(spark, sf_dir, [NMF_K])
    return nmf.top_n_joined(h, "pattern", "grp", "weight", TOP_GROUPS, "Top_7_Groups")


@register("q_nmf_metrics")
def q_nmf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frobenius error and pseudo R2 per K in 2..10, chosen K by the smallest
    R2 gain (the reference's rule) (L26, L27, H13)."""
    _, _, m = _fit(spark, sf_dir, K_RANGE)
    chosen = nmf.choose_k(m).scalar()
    return m.select("K", "Reconstruction_Error", "Pseudo_R2", "converged", (F.col("K") == chosen).alias("chosen"))


@register("q_choose_nmf_k", with_items(f"""
, c AS (SELECT grp, SUM(rev_share * rev_share) AS q FROM sh WHERE grp IS NOT NULL GROUP BY grp)
, r AS (SELECT q, ROW_NUMBER() OVER (ORDER BY q DESC, grp) AS K FROM c)
, m AS (SELECT K, SUM(q) OVER (ORDER BY K) / SUM(q) OVER () AS Pseudo_R2 FROM r)
, g AS (SELECT K, Pseudo_R2, Pseudo_R2 - LAG(Pseudo_R2) OVER (ORDER BY K) AS gain FROM m WHERE K BETWEEN 2 AND 10)
SELECT CAST(K AS INTEGER) AS K, {R6("Pseudo_R2")} AS Pseudo_R2,
       K = COALESCE((SELECT K FROM g WHERE gain IS NOT NULL ORDER BY gain, K LIMIT 1),
                    (SELECT K FROM g ORDER BY Pseudo_R2 DESC LIMIT 1)) AS smallest_gain,
       K = (SELECT MAX(K) FROM g WHERE gain >= 0.1 * (SELECT gain FROM g WHERE K = 3)) AS elbow FROM g""", SHARES_CTE))
def q_choose_nmf_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules that choose K (H13, L27) on the pseudo R2 of the factorisation
    that keeps the K heaviest product groups, which needs no fit."""
    s = shares(spark, sf_dir).filter(F.col("grp").isNotNull())
    c = s.groupBy("grp").agg(F.sum(F.col("rev_share") * F.col("rev_share")).alias("q"))
    total = c.select(F.sum("q")).scalar()
    top = c.orderBy(F.desc("q"), "grp").limit(max(K_RANGE))
    w = Window.orderBy(F.desc("q"), "grp")                # bounded: the ten heaviest groups
    m = (top.select(F.row_number().over(w).alias("K"), (F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total)
                    .alias("Pseudo_R2")).filter(F.col("K") >= min(K_RANGE)))
    return m.select("K", r6("Pseudo_R2").alias("Pseudo_R2"), (F.col("K") == nmf.choose_k(m).scalar()).alias("smallest_gain"),
                    (F.col("K") == nmf.choose_k(m, "elbow").scalar()).alias("elbow"))


@register("q_nmf_branch_patterns")
def q_nmf_branch_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant NMF pattern, its weight and the entropy of each branch's
    pattern mix (H16, K17 on the fitted W)."""
    w, _, _ = _fit(spark, sf_dir, [NMF_K])
    w = cut_lineage(w.select("branch", "pattern", "weight"))
    return nmf.dominant(w).join(nmf.entropy(w), "branch")


SHARE_W = """wl AS (SELECT branch, grp AS pattern, rev_share AS weight FROM sh WHERE grp IS NOT NULL)"""


@register("q_dominant_pattern", with_items(f"""
SELECT branch, Dominant_Pattern, {R6("Dominant_Weight", 9)} AS Dominant_Weight FROM (
  SELECT branch, pattern AS Dominant_Pattern, weight AS Dominant_Weight,
         ROW_NUMBER() OVER (PARTITION BY branch ORDER BY weight DESC, pattern) AS rn FROM wl) WHERE rn = 1""",
                                           SHARES_CTE, SHARE_W))
def q_dominant_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """argmax pattern and weight per branch, first on ties."""
    wl = shares(spark, sf_dir).filter(F.col("grp").isNotNull()).select(
        "branch", F.col("grp").alias("pattern"), F.col("rev_share").alias("weight"))
    d = nmf.dominant(wl)
    return d.select("branch", "Dominant_Pattern", r6("Dominant_Weight", 9).alias("Dominant_Weight"))


@register("q_entropy", with_items(f"""
, p AS (SELECT branch, weight / SUM(weight) OVER (PARTITION BY branch) AS p FROM wl)
SELECT branch, {R6("-SUM(CASE WHEN p > 0 THEN p * LN(p) ELSE 0 END)", 9)} AS Entropy FROM p GROUP BY branch""",
                                  SHARES_CTE, SHARE_W))
def q_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversification entropy of every branch's mix."""
    wl = shares(spark, sf_dir).filter(F.col("grp").isNotNull()).select(
        "branch", F.col("grp").alias("pattern"), F.col("rev_share").alias("weight"))
    return nmf.entropy(wl).select("branch", r6("Entropy", 9).alias("Entropy"))


@register("q_top_branches_per_pattern", with_items(f"""
SELECT pattern AS Pattern, Rank, branch AS Branch, {R6("weight", 9)} AS Weight FROM (
  SELECT pattern, branch, weight, ROW_NUMBER() OVER (PARTITION BY pattern ORDER BY weight DESC, branch) AS Rank
  FROM wl) WHERE Rank <= {TOP_BRANCHES}""", SHARES_CTE, SHARE_W))
def q_top_branches_per_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 branches of every pattern with rank and weight."""
    wl = shares(spark, sf_dir).filter(F.col("grp").isNotNull()).select(
        "branch", F.col("grp").alias("pattern"), F.col("rev_share").alias("weight"))
    t = nmf.top_n(wl, "pattern", "branch", "weight", TOP_BRANCHES)
    return t.select(F.col("pattern").alias("Pattern"), F.col("Rank").cast("bigint").alias("Rank"),
                    F.col("branch").alias("Branch"), r6("weight", 9).alias("Weight"))


@register("q_pattern_top_features", with_items(f"""
SELECT branch, STRING_AGG(pattern, ', ' ORDER BY rn) AS Top_7_Groups FROM (
  SELECT branch, pattern, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY weight DESC, pattern) AS rn FROM wl)
WHERE rn <= {TOP_GROUPS} GROUP BY branch""", SHARES_CTE, SHARE_W))
def q_pattern_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-7 features of every row joined with ', ' (H15)."""
    wl = shares(spark, sf_dir).filter(F.col("grp").isNotNull()).select(
        "branch", F.col("grp").alias("pattern"), F.col("rev_share").alias("weight"))
    return nmf.top_n_joined(wl, "branch", "pattern", "weight", TOP_GROUPS, "Top_7_Groups")

