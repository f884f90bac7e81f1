"""Product clustering queries: global (L1, L3, L5-L8, K16, G7-G10) and per
branch (L4, D15f, H2-H4, K15), opening dynamics (H8-H10, G16, G17).

Products are clustered at the *family* grain (brand + type, ~150 per
branch), the grain closest to the reference's menu items. Cluster ids are
arbitrary in any k-means, so these queries have no SQL oracle; the profile,
label and tier operators are checked against SQL in ``plans/rules.py`` with a
deterministic cluster rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kmeans as km
from ..operators import profiles as pf
from ..operators import timeseries as ts
from ..operators.products import (BRANCH_FEATURES, GLOBAL_FEATURES, branch_product_table, product_table,
                                  with_global_shares)
from ..functions.exprs import r6
from ..session import cut_lineage
from ..sources.tables import items, with_items
from .registry import register
from .sqlparts import R6, branch_product_ctes, product_table_ctes
from .timeseries import monthly_ctes as _monthly_ctes

ALL_BRANCHES_LABEL = "All Branches (Combined)"
K_VALUES = tuple(range(3, 9))
MIN_PRODUCTS = 30
MIN_CLUSTER_RATIO = 0.05
CLIP_QUANTILE = 0.01
STARTS = 16        # weighted seeding: within 1 % of 80 plain starts or better (tests/test_models.py)
MAX_ITER = 300     # the reference's limit; fits end when no model moves
PRODUCT_GRAIN = "family"


@dataclass
class ClusterRun:
    assignments: DataFrame   # product rows + Cluster (selected k)
    k_scores: DataFrame      # per (branch, k) diagnostics + selected
    profiles: DataFrame      # per (branch, Cluster)


def _fit(table: DataFrame, features, min_points: int) -> tuple[DataFrame, DataFrame]:
    g = ["branch"]
    pts = km.feature_matrix(table, g, "Product", features, CLIP_QUANTILE)
    models, pts = km.fit_kmeans(pts, g, "Product", K_VALUES, starts=STARTS, max_iter=MAX_ITER, min_points=min_points)
    best = cut_lineage(km.best_restart(models, g))
    assigned = cut_lineage(km.assign(pts, best, g, "Product").drop("r"))
    scores = km.choose_k(km.k_scores(assigned, best, g), g, MIN_CLUSTER_RATIO)
    selected = scores.filter("selected").select("branch", "k")
    chosen = assigned.join(selected, ["branch", "k"]).select("branch", "Product", F.col("cluster").alias("Cluster"))
    return chosen, scores


def global_run(spark: SparkSession, sf_dir: str) -> ClusterRun:
    """Global product clustering over all branches (one group)."""
    pt = product_table(items(spark, sf_dir), product=PRODUCT_GRAIN).withColumn("branch", F.lit(ALL_BRANCHES_LABEL))
    pt = cut_lineage(pt)
    chosen, scores = _fit(pt, GLOBAL_FEATURES, min_points=2)
    assign = with_global_shares(pt.join(chosen, ["branch", "Product"]))
    prof = pf.label_clusters(pf.profiles(assign, ["branch"]), ["branch"])
    prof = prof.join(pf.top_products(assign, ["branch"]), ["branch", "Cluster"], "left")
    labels = prof.select("branch", "Cluster", "ClusterLabel", "SuggestedAction")
    assign = assign.join(labels, ["branch", "Cluster"], "left")
    return ClusterRun(assign, scores, prof)


def branch_run(spark: SparkSession, sf_dir: str) -> ClusterRun:
    """Independent clustering inside every branch with >= MIN_PRODUCTS products."""
    bt = cut_lineage(branch_product_table(items(spark, sf_dir), product=PRODUCT_GRAIN))
    chosen, scores = _fit(bt, BRANCH_FEATURES, min_points=MIN_PRODUCTS)
    assign = bt.join(chosen, ["branch", "Product"])
    prof = pf.success_tiers(pf.profiles(assign, ["branch"], per_branch=True), ["branch"])
    prof = prof.join(pf.top_products(assign, ["branch"]), ["branch", "Cluster"], "left")
    tiers = prof.select("branch", "Cluster", "SuccessRank", "SuccessTier", "SuggestedAction")
    return ClusterRun(assign.join(tiers, ["branch", "Cluster"], "left"), scores, prof)


def skipped_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches not clustered, with their product count and reason (D15f)."""
    bt = branch_product_table(items(spark, sf_dir), product=PRODUCT_GRAIN)
    n = bt.groupBy("branch").agg(F.count(F.lit(1)).alias("n_products"))
    k_min, k_max = min(K_VALUES), F.least(F.lit(max(K_VALUES)), F.col("n_products") - 1)
    reason = (F.when(F.col("n_products") < MIN_PRODUCTS, F.lit("below min-products threshold"))
              .when(F.lit(max(2, k_min)) > k_max, F.lit("invalid k range after bounds check")))
    return n.withColumn("reason", reason).filter(F.col("reason").isNotNull())


_ASSIGN_COLS = ["branch", "Product", "Category", "Division", "Sales", "Cost", "Profit", "Qty", "MarginPct",
                "AvgPrice", "TakeAwayShare", "TableShare", "TotersShare", "Cluster"]


@register("q_kmeans_global")
def q_kmeans_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global product assignments with cluster label, action, sales/profit
    share (L3, F5, G8)."""
    r = global_run(spark, sf_dir)
    return r.assignments.select(*_ASSIGN_COLS, "BranchPenetration", "SalesShare", "ProfitShare",
                                "ClusterLabel", "SuggestedAction")


@register("q_k_scores")
def q_k_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global k diagnostics k=3..8: inertia, silhouette, cluster size ratios,
    selected (L5-L8, G24, D16f, I14, C14)."""
    return global_run(spark, sf_dir).k_scores


@register("q_cluster_profiles")
def q_cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global cluster profiles with labels, actions, top-8 products."""
    return global_run(spark, sf_dir).profiles


@register("q_kmeans_by_branch")
def q_kmeans_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-branch product assignments with success rank and tier (L4)."""
    r = branch_run(spark, sf_dir)
    return r.assignments.select(*_ASSIGN_COLS, "SalesShareInBranch", "ProfitShareInBranch", "SuccessRank",
                                "SuccessTier", "SuggestedAction")


@register("q_branch_k_scores")
def q_branch_k_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-branch k diagnostics with the selected k (L4, L5, D15f)."""
    return branch_run(spark, sf_dir).k_scores


@register("q_success_tiers")
def q_success_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-branch cluster profiles with SuccessScore, rank, tier, action and
    top-8 products (G7, H2-H4, K15, G10)."""
    return branch_run(spark, sf_dir).profiles


@register("q_skipped_branches", with_items(f"""
SELECT branch, n_products, reason FROM (
  SELECT branch, CAST(COUNT(DISTINCT family) AS INTEGER) AS n_products,
         CASE WHEN COUNT(DISTINCT family) < {MIN_PRODUCTS} THEN 'below min-products threshold'
              WHEN {max(2, min(K_VALUES))} > LEAST({max(K_VALUES)}, COUNT(DISTINCT family) - 1)
              THEN 'invalid k range after bounds check' END AS reason
  FROM items GROUP BY branch) WHERE reason IS NOT NULL"""))
def q_skipped_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches below the product threshold (D15f)."""
    return skipped_branches(spark, sf_dir).select("branch", F.col("n_products").cast("int"), "reason")


# ------------------------------------------------------------ opening dynamics
OPENING_FEATURES = ["initial_zeros", "avg_first3", "vol_first3", "growth_first3"]
OPENING_K = 3


SERIES = ["product", "year"]


def _opening(spark: SparkSession, sf_dir: str):
    yearly = cut_lineage(ts.yearly_sales(items(spark, sf_dir), "product"))
    feats = cut_lineage(ts.opening_features(yearly, SERIES)).withColumn("grp", F.lit(ALL_BRANCHES_LABEL))
    named = feats.select("grp", F.concat_ws("/", *SERIES).alias("Product"), *OPENING_FEATURES)
    pts = km.feature_matrix(named, ["grp"], "Product", OPENING_FEATURES, clip_quantile=0.0)
    models, pts = km.fit_kmeans(pts, ["grp"], "Product", [OPENING_K], starts=STARTS, max_iter=MAX_ITER)
    a = km.assign(pts, km.best_restart(models, ["grp"]), ["grp"], "Product")
    parts = F.split("Product", "/")
    clusters = a.select(parts[0].alias("product"), parts[1].cast("int").alias("year"), F.col("cluster"))
    return yearly, feats, clusters


@register("q_opening_clusters")
def q_opening_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KMeans(3) on standardised opening features; feature means per cluster
    (L3, G16). Clusters are ordered by their mean opening month."""
    _, feats, clusters = _opening(spark, sf_dir)
    j = feats.join(clusters, SERIES)
    return j.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                    *[F.avg(f).alias(f) for f in OPENING_FEATURES])


@register("q_opening_trajectory")
def q_opening_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean first-six-month trajectory per opening cluster, keyed by product
    (H10, G17)."""
    yearly, _, clusters = _opening(spark, sf_dir)
    tr = ts.opening_trajectory(yearly, SERIES).join(clusters, SERIES)
    return tr.groupBy("cluster", "pos").agg(F.avg("relative_sales").alias("relative_sales"),
                                            F.count(F.lit(1)).alias("n"))


# ------------------------------------------------- SQL-checkable building blocks
def _feature_sql(src: str, feats: list[str], group: str, key: str, q: float) -> str:
    """Oracle for ``kmeans.feature_matrix``: median impute, quantile clip,
    population standardisation per group."""
    med = ", ".join(f"MEDIAN(f{i}) AS med{i}" for i in range(len(feats)))
    raw = ", ".join(f'CASE WHEN isinf("{f}") OR isnan("{f}") THEN NULL ELSE "{f}" END AS f{i}'
                    for i, f in enumerate(feats))
    filled = ", ".join(f"COALESCE(f{i}, med{i}, 0) AS f{i}" for i in range(len(feats)))
    qs = ", ".join(f"QUANTILE_CONT(f{i}, {q}) AS lo{i}, QUANTILE_CONT(f{i}, {1 - q}) AS hi{i}"
                   for i in range(len(feats)))
    clipped = ", ".join(f"LEAST(GREATEST(f{i}, lo{i}), hi{i}) AS f{i}" for i in range(len(feats)))
    mom = ", ".join(f"AVG(f{i}) AS mu{i}, STDDEV_POP(f{i}) AS sd{i}" for i in range(len(feats)))
    z = ", ".join(R6(f"(f{i} - mu{i}) / CASE WHEN sd{i} > 1e-12 THEN sd{i} ELSE 1 END") + f" AS z{i}"
                  for i in range(len(feats)))
    return f"""
, r0 AS (SELECT {group} AS grp_key, {key} AS Product, {raw} FROM {src})
, m0 AS (SELECT grp_key, {med} FROM r0 GROUP BY grp_key)
, r1 AS (SELECT r0.grp_key, Product, {filled} FROM r0 JOIN m0 ON r0.grp_key = m0.grp_key)
, q0 AS (SELECT grp_key, {qs} FROM r1 GROUP BY grp_key)
, r2 AS (SELECT r1.grp_key, Product, {clipped} FROM r1 JOIN q0 ON r1.grp_key = q0.grp_key)
, s0 AS (SELECT grp_key, {mom} FROM r2 GROUP BY grp_key)
SELECT r2.grp_key AS branch, Product, {z} FROM r2 JOIN s0 ON r2.grp_key = s0.grp_key"""


def _fm_out(pts: DataFrame, p: int) -> DataFrame:
    return pts.select("branch", "Product", *[r6(F.col("x")[i]).alias(f"z{i}") for i in range(p)])


@register("q_feature_matrix", with_items(
    _feature_sql("pt", GLOBAL_FEATURES, f"'{ALL_BRANCHES_LABEL}'", "Product", CLIP_QUANTILE),
    *product_table_ctes("family")))
def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global clustering features: inf -> missing, median impute, 1 % / 99 %
    winsorising, population z-scores (L1, D18f, K7, K8)."""
    pt = product_table(items(spark, sf_dir), product=PRODUCT_GRAIN).withColumn("branch", F.lit(ALL_BRANCHES_LABEL))
    return _fm_out(km.feature_matrix(pt, ["branch"], "Product", GLOBAL_FEATURES, CLIP_QUANTILE), len(GLOBAL_FEATURES))


@register("q_feature_matrix_by_branch", with_items(
    _feature_sql("bpt", BRANCH_FEATURES, "branch", "Product", CLIP_QUANTILE), *branch_product_ctes("family")))
def q_feature_matrix_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-branch clustering features, statistics per branch (L1, L2)."""
    bt = branch_product_table(items(spark, sf_dir), product=PRODUCT_GRAIN)
    return _fm_out(km.feature_matrix(bt, ["branch"], "Product", BRANCH_FEATURES, CLIP_QUANTILE),
                   len(BRANCH_FEATURES))


#: Common table expressions (behind ``branch_product_ctes``) ending in ``si``: the
#: silhouette of every product by brute force over all pairs of a branch.
SILHOUETTE_SQL = _feature_sql("bpt", BRANCH_FEATURES, "branch", "Product", CLIP_QUANTILE).replace(
    "SELECT r2.grp_key AS branch, Product,", ", zz AS (SELECT r2.grp_key AS branch, Product,") + f""")
, lab AS (SELECT zz.*, DENSE_RANK() OVER (ORDER BY split_part(zz.Product, ' ', 2)) - 1 AS cl FROM zz)
, d AS (SELECT a.branch, a.Product, a.cl, b.cl AS cl2,
               {" + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(BRANCH_FEATURES)))} AS d2
        FROM lab a JOIN lab b ON a.branch = b.branch AND a.Product <> b.Product)
, pc AS (SELECT branch, Product, cl, cl2, AVG(d2) AS md FROM d GROUP BY ALL)
, sab AS (SELECT p.branch, p.Product,
               MAX(CASE WHEN p.cl = p.cl2 THEN p.md END) AS a, MIN(CASE WHEN p.cl <> p.cl2 THEN p.md END) AS b
        FROM pc p GROUP BY ALL)
, si AS (SELECT sab.branch, CASE WHEN sab.a IS NULL THEN 0 ELSE (sab.b - sab.a) / GREATEST(sab.a, sab.b) END AS v FROM sab)"""


def silhouette_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(branch, silhouette) of the per-branch features labelled by product type."""
    bt = branch_product_table(items(spark, sf_dir), product=PRODUCT_GRAIN)
    pts = km.feature_matrix(bt, ["branch"], "Product", BRANCH_FEATURES, CLIP_QUANTILE)
    pts = pts.withColumn("x", F.transform("x", lambda v: F.round(v * F.lit(1.0 + 1e-12), 6)))
    types = pts.select(F.split("Product", " ")[1].alias("t")).distinct().withColumn(
        "cluster", (F.dense_rank().over(Window.orderBy("t")) - 1).cast("int"))       # bounded: type domain
    lab = pts.withColumn("t", F.split("Product", " ")[1]).join(types, "t").withColumn("k", F.lit(0))
    return km.silhouette(lab, ["branch"]).select("branch", "silhouette")


@register("q_silhouette_rule", with_items(
    SILHOUETTE_SQL + f"SELECT branch, {R6('AVG(v)', 9)} AS silhouette FROM si GROUP BY branch", *branch_product_ctes("family")))
def q_silhouette_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean silhouette (squared Euclidean) per branch of the per-branch
    feature matrix labelled by product type; the oracle is the brute-force
    all-pairs SQL, the Spark side the O(n k) cluster-sum form (L6)."""
    return silhouette_by_type(spark, sf_dir).select("branch", r6("silhouette", 9).alias("silhouette"))


@register("q_kmeans_assign_step", with_items(
    _feature_sql("bpt", BRANCH_FEATURES, "branch", "Product", CLIP_QUANTILE).replace(
        "SELECT r2.grp_key AS branch, Product,", ", zz AS (SELECT r2.grp_key AS branch, Product,") + f""")
, lab AS (SELECT *, split_part(Product, ' ', 2) AS t FROM zz)
, ce AS (SELECT branch, t, {", ".join(f"AVG(z{i}) AS c{i}" for i in range(len(BRANCH_FEATURES)))}, COUNT(*) AS n,
                DENSE_RANK() OVER (PARTITION BY branch ORDER BY t) - 1 AS cid FROM lab GROUP BY branch, t)
, d AS (SELECT lab.branch, Product, cid, {" + ".join(f"(z{i} - c{i}) * (z{i} - c{i})" for i in range(len(BRANCH_FEATURES)))} AS d2
        FROM lab JOIN ce ON lab.branch = ce.branch)
, m AS (SELECT branch, Product, MIN(d2) AS dist, arg_min(cid, {{'d': d2, 'c': cid}}) AS cluster FROM d GROUP BY ALL)
SELECT branch, CAST(cluster AS INTEGER) AS cluster, COUNT(*) AS size, {R6("SUM(dist)", 4)} AS inertia FROM m GROUP BY ALL""",
    *branch_product_ctes("family")))
def q_kmeans_assign_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment step: products to the nearest of their branch's type
    centres, size and squared distance of every cluster (L3, L8)."""
    bt = branch_product_table(items(spark, sf_dir), product=PRODUCT_GRAIN)
    pts = km.feature_matrix(bt, ["branch"], "Product", BRANCH_FEATURES, CLIP_QUANTILE)
    pts = cut_lineage(pts.withColumn("x", F.transform("x", lambda v: F.round(v * F.lit(1.0 + 1e-12), 6))))
    p = len(BRANCH_FEATURES)
    mean = F.array(*[F.avg(F.col("x")[i]) for i in range(p)])
    cent = pts.groupBy("branch", F.split("Product", " ")[1].alias("t")).agg(mean.alias("c"))
    models = cent.groupBy("branch").agg(F.sort_array(F.collect_list(F.struct("t", "c"))).alias("s")).select(
        "branch", F.size("s").alias("k"), F.lit(0).alias("r"), F.col("s.c").alias("centers"))
    a = km.assign(pts, models, ["branch"], "Product")
    return a.groupBy("branch", "cluster").agg(F.count(F.lit(1)).alias("size"), r6(F.sum("dist"), 4).alias("inertia"))


def _choose_sql() -> str:
    ratio = "LEAST(CAST(COUNT(*) FILTER (WHERE Sales < 400 * k) AS DOUBLE), COUNT(*) FILTER (WHERE Sales >= 400 * k)) / COUNT(*)"
    return with_items(f"""
, s AS (SELECT branch, CAST(k AS INTEGER) AS k, {ratio} AS ratio,
               CASE WHEN k % 3 = 0 THEN NULL ELSE ROUND(AVG(MarginPct), 2) END AS silhouette
        FROM bpt, range({min(K_VALUES)}, {max(K_VALUES) + 1}) x(k) GROUP BY branch, k)
, c AS (SELECT *, ratio >= {MIN_CLUSTER_RATIO} OR NOT MAX(ratio >= {MIN_CLUSTER_RATIO}) OVER (PARTITION BY branch) AS cand FROM s)
SELECT branch, k, {R6("ratio")} AS min_cluster_ratio, silhouette,
       ROW_NUMBER() OVER (PARTITION BY branch ORDER BY cand DESC, silhouette DESC NULLS LAST, k) = 1 AS selected FROM c""",
                      *branch_product_ctes("family"))


@register("q_choose_k", _choose_sql())
def q_choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that chooses k (D16f, I14, C14) on scores that need no fit: the
    smaller share of products below and above a sales cut as size ratio, and the
    mean margin, missing for every third k and equal for the others, as silhouette."""
    bt = branch_product_table(items(spark, sf_dir), product=PRODUCT_GRAIN)
    rows = bt.select("branch", "Sales", "MarginPct", F.explode(F.array(*[F.lit(k) for k in K_VALUES])).alias("k"))
    low = F.coalesce(F.col("Sales") < 400 * F.col("k"), F.lit(False))
    s = rows.groupBy("branch", "k").agg(F.count_if(low).alias("lo"), F.count_if(F.col("Sales") >= 400 * F.col("k")).alias("hi"),
                                        F.count(F.lit(1)).alias("n"), F.round(F.avg("MarginPct"), 2).alias("m"))
    s = s.select("branch", "k", (F.least("lo", "hi") / F.col("n")).alias("min_cluster_ratio"),
                 F.when(F.col("k") % 3 != 0, F.col("m")).alias("silhouette"))
    c = km.choose_k(s, ["branch"], MIN_CLUSTER_RATIO)
    return c.select("branch", "k", r6("min_cluster_ratio").alias("min_cluster_ratio"), "silhouette", "selected")


@register("q_opening_features", with_items(f"""
, om AS (SELECT product, year, MIN(month) AS open_month FROM monthly WHERE month <= 12 AND sales <> 0 GROUP BY ALL)
, f3 AS (SELECT m.product, m.year, om.open_month, COUNT(*) AS n3, COUNT(*) FILTER (WHERE sales = 0) AS z3,
                AVG(sales) AS a, STDDEV_POP(sales) AS v, arg_max(sales, month) - arg_min(sales, month) AS g
         FROM monthly m JOIN om ON m.product = om.product AND m.year = om.year
         WHERE m.month <= 12 AND m.month BETWEEN om.open_month AND om.open_month + 2 GROUP BY ALL)
SELECT product, year, open_month - 1 AS initial_zeros, {R6("a", 4)} AS avg_first3, {R6("v", 4)} AS vol_first3,
       {R6("g", 4)} AS growth_first3 FROM f3 WHERE n3 = 3 AND z3 = 0""", *_monthly_ctes("product")))
def q_opening_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months before opening, mean / population std / growth of the first three
    active months per product and year (H8, H9)."""
    f = ts.opening_features(ts.yearly_sales(items(spark, sf_dir), "product"), SERIES)
    return f.select(*SERIES, F.col("initial_zeros").cast("int").alias("initial_zeros"),
                    r6("avg_first3", 4).alias("avg_first3"), r6("vol_first3", 4).alias("vol_first3"),
                    r6("growth_first3", 4).alias("growth_first3"))


@register("q_selected_k")
def q_selected_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected-k row per branch, falling back to the best silhouette (I8, M7)."""
    s = branch_run(spark, sf_dir).k_scores
    w = Window.partitionBy("branch").orderBy(F.desc("selected"), F.desc_nulls_last("silhouette"), "k")
    return s.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _label_sql() -> str:
    L = pf
    return f"""
, cats AS (SELECT Category, CAST(DENSE_RANK() OVER (ORDER BY Category) - 1 AS INTEGER) AS Cluster
           FROM (SELECT DISTINCT Category FROM pt))
, a AS (SELECT pt.*, cats.Cluster FROM pt JOIN cats ON pt.Category = cats.Category)
, p AS (SELECT Cluster, COUNT(Product) AS n_products, SUM(Sales) AS total_sales, MEDIAN(Sales) AS median_sales,
               MEDIAN(MarginPct) AS median_margin_pct, AVG(BranchPenetration) AS avg_branch_penetration,
               AVG(TakeAwayShare) AS avg_takeaway_share, AVG(TotersShare) AS avg_toters_share FROM a GROUP BY Cluster)
, q AS (SELECT QUANTILE_CONT(median_sales, 0.75) AS sq75, QUANTILE_CONT(avg_branch_penetration, 0.75) AS bq75,
               QUANTILE_CONT(avg_branch_penetration, 0.5) AS bq50, QUANTILE_CONT(avg_toters_share, 0.75) AS tq75,
               QUANTILE_CONT(median_margin_pct, 0.25) AS mq25 FROM p)
, l AS (SELECT p.*, CASE
          WHEN median_sales >= sq75 AND avg_branch_penetration >= bq75 THEN '{L.LABEL_CORE[0]}'
          WHEN avg_takeaway_share >= {L.TAKEAWAY_NICHE_SHARE} AND avg_branch_penetration <= bq50 THEN '{L.LABEL_TAKEAWAY[0]}'
          WHEN avg_toters_share >= tq75 THEN '{L.LABEL_TOTERS[0]}'
          WHEN median_margin_pct <= mq25 THEN '{L.LABEL_MARGIN[0]}'
          ELSE '{L.LABEL_GROWTH[0]}' END AS lab FROM p, q)
, t AS (SELECT Cluster, STRING_AGG(Product, '; ' ORDER BY rn) AS TopProducts FROM (
          SELECT Cluster, Product, ROW_NUMBER() OVER (PARTITION BY Cluster ORDER BY Sales DESC, Product) AS rn FROM a)
        WHERE rn <= {L.TOP_PRODUCTS_N} GROUP BY Cluster)
SELECT l.Cluster, n_products, ROUND(total_sales, 4) AS total_sales, {R6("median_sales", 4)} AS median_sales,
       'C' || CAST(l.Cluster AS VARCHAR) || ': ' || lab AS ClusterLabel, TopProducts
FROM l JOIN t ON l.Cluster = t.Cluster"""


@register("q_cluster_labels_rule", with_items(_label_sql(), *product_table_ctes("family")))
def q_cluster_labels_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global segment profiles with the ordered label rules on profile
    quantiles and the top-8 products, segments = product type (G7, G9, G10,
    K16, F5)."""
    pt = product_table(items(spark, sf_dir), product=PRODUCT_GRAIN).withColumn("branch", F.lit(ALL_BRANCHES_LABEL))
    cats = pt.select("Category").distinct().withColumn(
        "Cluster", (F.dense_rank().over(Window.orderBy("Category")) - 1).cast("int"))   # bounded: type domain
    a = pt.join(cats, "Category")
    prof = pf.label_clusters(pf.profiles(a, ["branch"]), ["branch"])
    prof = prof.join(pf.top_products(a, ["branch"]), ["branch", "Cluster"])
    return prof.select("Cluster", "n_products", F.round("total_sales", 4).alias("total_sales"),
                       r6("median_sales", 4).alias("median_sales"), "ClusterLabel", "TopProducts")


@register("q_product_trajectories", with_items(f"""
, om AS (SELECT product, year, MIN(month) AS o FROM monthly WHERE month <= 12 AND sales <> 0 GROUP BY ALL)
, j AS (SELECT m.product, m.year, m.month - om.o + 1 AS pos, m.sales
        FROM monthly m JOIN om ON m.product = om.product AND m.year = om.year
        WHERE m.month <= 12 AND m.month BETWEEN om.o AND om.o + 5)
, ok AS (SELECT product, year FROM j GROUP BY ALL HAVING COUNT(*) = 6 AND COUNT(*) FILTER (WHERE sales = 0) = 0)
, b AS (SELECT product, year, sales AS s1 FROM j WHERE pos = 1)
SELECT j.product, j.year, CAST(pos AS INTEGER) AS pos, {R6("sales / s1")} AS relative_sales
FROM j JOIN ok ON j.product = ok.product AND j.year = ok.year
JOIN b ON j.product = b.product AND j.year = b.year""", *_monthly_ctes("product")))
def q_product_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First six months from the opening indexed to the first month, for series
    with six non-zero months in the year, keyed by product and year (H10, X4)."""
    t = ts.opening_trajectory(ts.yearly_sales(items(spark, sf_dir), "product"), SERIES)
    return t.select(*SERIES, F.col("pos").cast("int").alias("pos"), r6("relative_sales").alias("relative_sales"))
