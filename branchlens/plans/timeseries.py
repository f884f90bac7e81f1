"""Monthly seasonality and forecast queries: H5-H12, I9, I11, C12, C15,
L15-L18 on the branch x month series of every year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6, rm, rounded
from ..operators import timeseries as ts
from ..sources.tables import items, with_items
from .registry import register
from .sqlparts import R6

KEYS = ["branch", "year"]


def branch_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.monthly_sales(items(spark, sf_dir), "branch")


def monthly_ctes(key: str = "branch") -> list[str]:
    return [
        f"""ms AS (SELECT {key}, year, month AS m, SUM(price) AS sales FROM items GROUP BY ALL
        UNION ALL SELECT {key}, year - 1, 13, SUM(price) FROM items WHERE month = 1 GROUP BY ALL)""",
        f"""grid AS (SELECT b.{key}, b.year, CAST(g.month AS INTEGER) AS month
        FROM (SELECT DISTINCT {key}, year FROM ms WHERE m <= 12) b, range(1, 14) g(month))""",
        f"""monthly AS (SELECT grid.{key}, grid.year, grid.month, CASE WHEN grid.month <= 12 THEN COALESCE(ms.sales, 0) ELSE ms.sales END AS sales
        FROM grid LEFT JOIN ms ON grid.{key} = ms.{key} AND grid.year = ms.year AND grid.month = ms.m)""",
    ]


NORM_CTES = monthly_ctes() + [
    """zx AS (SELECT branch, year, month, CASE WHEN sales <> 0 THEN sales END AS x FROM monthly WHERE month <= 12)""",
    """rm AS (SELECT branch, year, AVG(x) AS row_mean FROM zx GROUP BY branch, year)""",
    """nz AS (SELECT zx.branch, zx.year, zx.month, zx.x, rm.row_mean, zx.x / rm.row_mean AS norm
        FROM zx JOIN rm ON zx.branch = rm.branch AND zx.year = rm.year)""",
]


@register("q_month_norm", with_items(f"""
SELECT branch, year, month, ROUND(x, 4) AS sales, {R6("row_mean", 4)} AS row_mean, {R6("norm")} AS norm FROM nz""",
                                     *NORM_CTES))
def q_month_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch months divided by the branch's mean month, zeros as missing
    (H11, K5, F6)."""
    n = ts.norm_zero_as_null(branch_monthly(spark, sf_dir), KEYS)
    return n.select(*KEYS, "month", rm("x").alias("sales"), r6("row_mean", 4).alias("row_mean"), r6("norm").alias("norm"))


@register("q_rolling3", with_items(f"""
SELECT branch, year, month, {R6("CASE WHEN COUNT(norm) OVER w = 3 THEN AVG(norm) OVER w END")} AS rolling3
FROM nz WINDOW w AS (PARTITION BY branch, year ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
                                   *NORM_CTES))
def q_rolling3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-month rolling mean of the normalised series."""
    r = ts.rolling3(ts.norm_zero_as_null(branch_monthly(spark, sf_dir), KEYS), KEYS)
    return r.select(*KEYS, "month", r6("rolling3").alias("rolling3"))


@register("q_pct_change", with_items(f"""
, f AS (SELECT branch, year, month, LAST_VALUE(norm IGNORE NULLS) OVER (PARTITION BY branch, year ORDER BY month
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM nz)
SELECT branch, year, month, {R6("filled / LAG(filled) OVER (PARTITION BY branch, year ORDER BY month) - 1")} AS pct_change
FROM f""", *NORM_CTES))
def q_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-over-month change of the normalised series, forward filled."""
    p = ts.pct_change(ts.norm_zero_as_null(branch_monthly(spark, sf_dir), KEYS), KEYS)
    return p.select(*KEYS, "month", r6("pct_change").alias("pct_change"))


LAG_CORR_CTES = NORM_CTES + [
    """r3 AS (SELECT branch, year, month, norm,
        CASE WHEN COUNT(norm) OVER w = 3 THEN AVG(norm) OVER w END AS rolling3
        FROM nz WINDOW w AS (PARTITION BY branch, year ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
    """p3 AS (SELECT month, norm, LAG(rolling3) OVER (PARTITION BY branch, year ORDER BY month) AS prev3 FROM r3)""",
    """c3 AS (SELECT month, CORR(prev3, norm) AS corr, COUNT(*) AS n FROM p3
        WHERE month >= 4 AND prev3 IS NOT NULL AND norm IS NOT NULL GROUP BY month)""",
    """tc AS (SELECT month, n, corr, CASE WHEN n > 2 AND 1.0 - corr * corr <> 0
        THEN corr * SQRT((n - 2) / (1.0 - corr * corr)) END AS t_stat FROM c3)""",
]


@register("q_lag_corr", with_items(f"""
SELECT month, n, {R6("corr")} AS corr, {R6("t_stat")} AS t_stat FROM tc""", *LAG_CORR_CTES))
def q_lag_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson r between the rolling 3-month mean ending at month i-1 and
    month i, i = 4..12, pairwise complete, with its t statistic (L17)."""
    c = ts.lag_corr(ts.norm_zero_as_null(branch_monthly(spark, sf_dir), KEYS), KEYS)
    return c.select("month", "n", r6("corr").alias("corr"), r6("t_stat").alias("t_stat"))


# the oracle's coefficients are sums of logarithms, not a recurrence
@register("q_lag_corr_pvalue", with_items(f"""
, a AS (SELECT *, n - 2 AS v, atan(abs(t_stat) / sqrt(n - 2)) AS th FROM tc WHERE t_stat IS NOT NULL)
, x AS (SELECT j::DOUBLE AS j FROM range(0, 100000) t(j))
, co AS (SELECT j, exp(SUM(CASE WHEN j > 0 THEN ln((2 * j - 1) / (2 * j)) ELSE 0 END) OVER (ORDER BY j)) AS ev,
               exp(SUM(CASE WHEN j > 0 THEN ln(2 * j / (2 * j + 1)) ELSE 0 END) OVER (ORDER BY j)) AS od FROM x)
, e AS (SELECT month, SUM(CASE WHEN v % 2 = 0 THEN ev * cos(th) ** (2 * j) ELSE od * cos(th) ** (2 * j + 1) END) AS s
        FROM a, co WHERE j <= (v - CASE WHEN v % 2 = 0 THEN 2 ELSE 3 END) // 2 AND v > 1 GROUP BY month)
, i AS (SELECT a.month, CASE WHEN v % 2 = 0 THEN sin(th) * s ELSE 2 / pi() * (th + sin(th) * COALESCE(s, 0)) END AS inside
        FROM a LEFT JOIN e ON a.month = e.month)
SELECT tc.month, n, {R6("corr")} AS corr, {R6("t_stat")} AS t_stat, {R6("greatest(1 - inside, 0)", 5)} AS p_value
FROM tc LEFT JOIN i ON tc.month = i.month""", *LAG_CORR_CTES))
def q_lag_corr_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L17 with the two-sided p-value (Student t with n-2 degrees of freedom)."""
    c = ts.lag_corr(ts.norm_zero_as_null(branch_monthly(spark, sf_dir), KEYS), KEYS)
    return c.select("month", "n", r6("corr").alias("corr"), r6("t_stat").alias("t_stat"),
                    r6(ts.student_t_two_sided_p(F.col("t_stat"), F.col("n") - 2), 5).alias("p_value"))


def _corr_sql() -> str:
    pairs = [(i, j) for i in range(1, 13) for j in range(i, 13)]
    wide = ", ".join(f"MAX(CASE WHEN month = {i} THEN norm END) AS m{i}" for i in range(1, 13))
    rows = " UNION ALL ".join(f"SELECT {i} AS m1, {j} AS m2, CORR(m{i}, m{j}) AS corr FROM w" for i, j in pairs)
    return with_items(f"""
, w AS (SELECT branch, year, {wide} FROM nz GROUP BY branch, year)
, s AS ({rows})
SELECT m1, m2, {R6("corr")} AS corr FROM s
UNION ALL SELECT m2, m1, {R6("corr")} FROM s WHERE m1 <> m2""", *NORM_CTES)


@register("q_month_corr_matrix", _corr_sql())
def q_month_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month x month correlation matrix of the normalised series."""
    c = ts.month_corr_matrix(ts.norm_zero_as_null(branch_monthly(spark, sf_dir), KEYS), KEYS)
    return c.select("m1", "m2", r6("corr").alias("corr"))


LAG_CTES = monthly_ctes() + [
    """mb AS (SELECT branch, year, AVG(sales) AS branch_mean FROM monthly WHERE month <= 12 AND sales <> 0 GROUP BY branch, year)""",
    """nm AS (SELECT monthly.branch, monthly.year, month, sales, branch_mean, sales / branch_mean AS norm
        FROM monthly LEFT JOIN mb ON monthly.branch = mb.branch AND monthly.year = mb.year)""",
    """lf0 AS (SELECT branch, year, month AS t, month = 13 AS is_score,
        LAG(norm, 1) OVER w AS lag_1, LAG(norm, 2) OVER w AS lag_2,
        CASE WHEN COUNT(norm) OVER w3 = 3 THEN AVG(norm) OVER w3 END AS rolling_3,
        SUM(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER w4 AS nz4,
        SUM(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER w3 AS nz3,
        CASE WHEN month <= 12 THEN norm END AS target, sales AS actual_sales, branch_mean
        FROM nm WINDOW w AS (PARTITION BY branch, year ORDER BY month),
          w3 AS (PARTITION BY branch, year ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
          w4 AS (PARTITION BY branch, year ORDER BY month ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""",
    """lf AS (SELECT * FROM lf0 WHERE (t BETWEEN 4 AND 12 AND nz4 = 4) OR (t = 13 AND actual_sales IS NOT NULL AND nz3 = 3))""",
]


@register("q_lag_features", with_items(f"""
SELECT branch, year, t, is_score, {R6("lag_1")} AS lag_1, {R6("lag_2")} AS lag_2, {R6("rolling_3")} AS rolling_3,
       {R6("target")} AS target, ROUND(actual_sales, 4) AS actual_sales, {R6("branch_mean", 4)} AS branch_mean
FROM lf""", *LAG_CTES))
def q_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag-1, lag-2, previous-3 mean and target per branch-month; the
    next-January scoring rows (H6, H7, D10f)."""
    lf = ts.lag_features(branch_monthly(spark, sf_dir), KEYS)
    return rounded(lf, ["actual_sales"], ["lag_1", "lag_2", "rolling_3", "target"]).withColumn(
        "branch_mean", r6("branch_mean", 4))


def _cramer3() -> str:
    """Slopes of the centred 3-variable normal equations by Cramer's rule."""
    a = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    y = ["cy0", "cy1", "cy2"]

    def det(m):
        return (f"(({m[0][0]})*(({m[1][1]})*({m[2][2]})-({m[1][2]})*({m[2][1]}))"
                f"-({m[0][1]})*(({m[1][0]})*({m[2][2]})-({m[1][2]})*({m[2][0]}))"
                f"+({m[0][2]})*(({m[1][0]})*({m[2][1]})-({m[1][1]})*({m[2][0]})))")
    d = det(a)
    outs = []
    for k in range(3):
        mk = [[y[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]
        outs.append(f"{det(mk)} / {d} AS b{k}")
    return ", ".join(outs)


OLS_CTES = LAG_CTES + [
    """tr AS (SELECT * FROM lf WHERE NOT is_score)""",
    """st AS (SELECT COUNT(*) AS n_train, AVG(target) AS my, AVG(lag_1) AS m0, AVG(lag_2) AS m1, AVG(rolling_3) AS m2,
        COVAR_POP(lag_1, lag_1) AS c00, COVAR_POP(lag_1, lag_2) AS c01, COVAR_POP(lag_1, rolling_3) AS c02,
        COVAR_POP(lag_2, lag_2) AS c11, COVAR_POP(lag_2, rolling_3) AS c12, COVAR_POP(rolling_3, rolling_3) AS c22,
        COVAR_POP(lag_1, target) AS cy0, COVAR_POP(lag_2, target) AS cy1, COVAR_POP(rolling_3, target) AS cy2
        FROM tr)""",
    f"""beta AS (SELECT n_train, my, m0, m1, m2, {_cramer3()} FROM st)""",
    """sc AS (SELECT lf.branch, lf.year, lf.actual_sales,
        (beta.my + beta.b0 * (lf.lag_1 - beta.m0) + beta.b1 * (lf.lag_2 - beta.m1) + beta.b2 * (lf.rolling_3 - beta.m2))
          * lf.branch_mean AS predicted_sales
        FROM lf, beta WHERE lf.is_score)""",
]


def _ols_scored(spark: SparkSession, sf_dir: str):
    lf = ts.lag_features(branch_monthly(spark, sf_dir), KEYS).cache()
    model = ts.ols_fit(lf.filter(~F.col("is_score")))
    scored = (ts.ols_predict(lf.filter(F.col("is_score")), model)
              .withColumn("predicted_sales", F.col("predicted_norm") * F.col("branch_mean")))
    return scored, model


@register("q_ols_forecast", with_items("""
SELECT branch, year, ROUND(actual_sales, 4) AS actual_sales, ROUND(predicted_sales, 2) AS predicted_sales FROM sc""",
                                       *OLS_CTES))
def q_ols_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-January forecast per branch from standardised lag features."""
    scored, _ = _ols_scored(spark, sf_dir)
    return scored.select(*KEYS, rm("actual_sales").alias("actual_sales"),
                         F.round("predicted_sales", 2).alias("predicted_sales"))


@register("q_forecast_metrics", with_items(f"""
SELECT (SELECT n_train FROM beta) AS n_train, COUNT(*) AS n_scored,
       ROUND(AVG(ABS(actual_sales - predicted_sales)), 2) AS mae,
       {R6("1 - SUM((actual_sales - predicted_sales) ^ 2) / NULLIF(SUM((actual_sales - (SELECT AVG(actual_sales) FROM sc)) ^ 2), 0)")} AS r2,
       {R6("AVG(CASE WHEN actual_sales <> 0 THEN ABS((actual_sales - predicted_sales) / actual_sales) END) * 100", 4)} AS mape
FROM sc""", *OLS_CTES))
def q_forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAE, R2, MAPE of the next-January forecast, sample counts."""
    scored, model = _ols_scored(spark, sf_dir)
    m = ts.forecast_metrics(scored)
    return m.select(F.lit(model["n"]).cast("bigint").alias("n_train"), "n_scored",
                    F.round("mae", 2).alias("mae"), r6("r2").alias("r2"), r6("mape", 4).alias("mape"))


@register("q_ols_coefficients", with_items(f"""
, sd AS (SELECT SQRT(c00) AS s0, SQRT(c11) AS s1, SQRT(c22) AS s2 FROM st)
SELECT feature, {R6("coef")} AS coef FROM (
  SELECT 'lag_1' AS feature, b0 * s0 AS coef FROM beta, sd UNION ALL
  SELECT 'lag_2', b1 * s1 FROM beta, sd UNION ALL
  SELECT 'rolling_3', b2 * s2 FROM beta, sd)""", *OLS_CTES))
def q_ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised OLS coefficients of the forecast model."""
    lf = ts.lag_features(branch_monthly(spark, sf_dir), KEYS)
    model = ts.ols_fit(lf.filter(~F.col("is_score")))
    rows = [(f, float(c)) for f, c in zip(model["features"], model["coef"])]
    return spark.createDataFrame(rows, "feature string, coef double").select("feature", r6("coef").alias("coef"))


@register("q_seasonal_total_rank", with_items("""
, t AS (SELECT branch, year, SUM(sales) FILTER (WHERE month IN (11, 12, 13)) AS total FROM monthly GROUP BY ALL)
SELECT branch, year, ROUND(total, 4) AS Total_NovDecJan,
       ROW_NUMBER() OVER (PARTITION BY year ORDER BY total DESC, branch) AS rank FROM t""", *monthly_ctes()))
def q_seasonal_total_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch ranking by November + December + next January of every year
    (I11, C12, C15). One row per branch and year; a year's rank orders one row
    per branch (bounded by the branch count)."""
    m = branch_monthly(spark, sf_dir)
    t = m.groupBy(*KEYS).agg(F.sum(F.when(F.col("month").isin(11, 12, 13), F.col("sales"))).alias("total"))
    w = Window.partitionBy("year").orderBy(F.desc("total"), "branch")
    return t.select(*KEYS, rm("total").alias("Total_NovDecJan"), F.row_number().over(w).cast("bigint").alias("rank"))
