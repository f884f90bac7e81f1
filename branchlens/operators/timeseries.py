"""Monthly series operators (A10 long form, H5-H12, I11, L15-L18).

The reference keeps the months of one year as wide columns and walks rows in
Python. Here a series is long (keys..., month, sales), one per key and year of the
facts: one partial+final aggregation over the facts makes all months of a year,
then windows partitioned by the series run over at most 13 rows each. Missing
months are 0 as in the printed report.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]


def _year_sums(items: DataFrame, key: str) -> DataFrame:
    month = F.col("month")
    return items.select(key, "year", "month", "price").groupBy(key, "year").agg(
        *[F.sum(F.when(month == m, F.col("price"))).alias(f"m{m}") for m in range(1, 13)])


def yearly_sales(items: DataFrame, key: str) -> DataFrame:
    """(key, year, months): the sales of months 1..12 as one array, 0 when absent."""
    return _year_sums(items, key).select(
        key, "year", F.array(*[F.coalesce(f"m{m}", F.lit(0.0)) for m in range(1, 13)]).alias("months"))


def monthly_sales(items: DataFrame, key: str) -> DataFrame:
    """(key, year, month, sales) for months 1..12 of every year of the key and
    month 13 = January of the next year. Every series has 13 months: 0 when
    absent, but a next January without any sale is null, as it is not known."""
    year = _year_sums(items, key)
    w = Window.partitionBy(key).orderBy("year")
    after = F.when(F.lead("year").over(w) == F.col("year") + 1, F.lead("m1").over(w))
    months = [F.coalesce(f"m{m}", F.lit(0.0)) for m in range(1, 13)]
    return (year.withColumn("m13", after)
            .select(key, "year", F.posexplode(F.array(*months, "m13")).alias("pos", "sales"))
            .select(key, "year", (F.col("pos") + 1).alias("month"), "sales"))


def with_norm(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys`` name a series, here and below.) ``branch_mean`` = mean of the non-zero months 1..12 and
    ``norm`` = sales / branch_mean (H11, F6). The mean is an aggregate joined
    back on the key."""
    means = (monthly.filter((F.col("month") <= 12) & (F.col("sales") != 0))
             .groupBy(*keys).agg(F.avg("sales").alias("branch_mean")))
    return (monthly.join(means, keys, "left")
            .withColumn("norm", F.col("sales") / F.col("branch_mean")))


def lag_features(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Training rows (target month 4..12) and the scoring row (month 13).

    Train: the real values of months t-3..t are all non-zero; features
    lag_1, lag_2 (normalised), rolling_3 = mean of the three previous
    normalised months, target = normalised month t.
    Score (t = 13): next-January value present and months 10..12 non-zero."""
    w = Window.partitionBy(*keys).orderBy("month")
    df = with_norm(monthly, keys)
    prev3 = w.rowsBetween(-3, -1)
    df = (df
          .withColumn("lag_1", F.lag("norm", 1).over(w))
          .withColumn("lag_2", F.lag("norm", 2).over(w))
          .withColumn("rolling_3", F.when(F.count("norm").over(prev3) == 3, F.avg("norm").over(prev3)))
          .withColumn("n_nonzero_4", F.sum(F.when(F.col("sales") != 0, 1).otherwise(0)).over(w.rowsBetween(-3, 0)))
          .withColumn("n_nonzero_prev3", F.sum(F.when(F.col("sales") != 0, 1).otherwise(0)).over(prev3)))
    train = (F.col("month").between(4, 12)) & (F.col("n_nonzero_4") == 4)
    score = (F.col("month") == 13) & F.col("sales").isNotNull() & (F.col("n_nonzero_prev3") == 3)
    return (df.filter(train | score)
            .select(*keys, F.col("month").alias("t"), (F.col("month") == 13).alias("is_score"),
                    "lag_1", "lag_2", "rolling_3",
                    F.when(F.col("month") <= 12, F.col("norm")).alias("target"),
                    F.col("sales").alias("actual_sales"), "branch_mean"))


FEATURES = ["lag_1", "lag_2", "rolling_3"]


def ols_fit(train: DataFrame, features=FEATURES, target: str = "target") -> dict:
    """OLS with intercept on standardised features (StandardScaler +
    LinearRegression). The Gram sums (p^2 + p numbers) are one aggregate; the
    p x p solve runs on the driver. Returns raw-scale slopes, the mean vector,
    population std and standardised coefficients."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(target).alias("my")]
    for i, a in enumerate(features):
        aggs.append(F.avg(a).alias(f"m{i}"))
        aggs.append(F.covar_pop(a, target).alias(f"cy{i}"))
        for j, b in enumerate(features):
            if j >= i:
                aggs.append(F.covar_pop(a, b).alias(f"c{i}_{j}"))
    r = train.agg(*aggs).first().asDict()
    p = len(features)
    S = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            S[i, j] = S[j, i] = r[f"c{i}_{j}"]
    sy = np.array([r[f"cy{i}"] for i in range(p)])
    beta = np.linalg.lstsq(S, sy, rcond=None)[0]  # least norm where the design is singular
    sd = np.sqrt(np.diag(S))
    sd[sd == 0] = 1.0
    return {"n": r["n"], "intercept": r["my"], "mean": [r[f"m{i}"] for i in range(p)],
            "beta": beta.tolist(), "sd": sd.tolist(), "coef": (beta * sd).tolist(), "features": list(features)}


def ols_predict(df: DataFrame, model: dict) -> DataFrame:
    pred = F.lit(model["intercept"])
    for f, b, m in zip(model["features"], model["beta"], model["mean"]):
        pred = pred + F.lit(b) * (F.col(f) - F.lit(m))
    return df.withColumn("predicted_norm", pred)


def forecast_metrics(scored: DataFrame, actual: str = "actual_sales", pred: str = "predicted_sales") -> DataFrame:
    """MAE, R2 (against the mean of the actuals) and MAPE in percent over
    the rows with a non-zero actual (L16; a zero actual has no percentage
    error)."""
    mean_a = scored.select(F.avg(actual)).scalar()
    return scored.agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.avg(F.abs(F.col(actual) - F.col(pred))).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(F.pow(F.col(actual) - F.col(pred), 2)),
                                   F.sum(F.pow(F.col(actual) - mean_a, 2)))).alias("r2"),
        (F.avg(F.abs(F.try_divide(F.col(actual) - F.col(pred), F.col(actual)))) * 100).alias("mape"))


def norm_zero_as_null(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """timeseries variant: zeros are missing, norm = x / mean(non-missing);
    months 1..12 only (H11, K5)."""
    m = monthly.filter(F.col("month") <= 12).withColumn(
        "x", F.when(F.col("sales") != 0, F.col("sales")))
    means = m.groupBy(*keys).agg(F.avg("x").alias("row_mean"))
    return m.join(means, keys).withColumn("norm", F.col("x") / F.col("row_mean"))


def rolling3(norm: DataFrame, keys: list[str]) -> DataFrame:
    """3-month rolling mean needing 3 non-null values (H5)."""
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(-2, 0)
    return norm.withColumn("rolling3", F.when(F.count("norm").over(w) == 3, F.avg("norm").over(w)))


def pct_change(norm: DataFrame, keys: list[str]) -> DataFrame:
    """Period-over-period change with forward fill of missing months."""
    w = Window.partitionBy(*keys).orderBy("month")
    filled = F.last("norm", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (norm.withColumn("filled", filled)
            .withColumn("pct_change", F.col("filled") / F.lag("filled").over(w) - F.lit(1.0)))


def wide_months(norm: DataFrame, keys: list[str], value: str = "norm") -> DataFrame:
    """One row per key with columns m1..m12 (conditional aggregation)."""
    return norm.groupBy(*keys).agg(*[F.max(F.when(F.col("month") == i, F.col(value))).alias(f"m{i}")
                                   for i in range(1, 13)])


def month_corr_matrix(norm: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every month pair (L18): all
    78 ``corr`` aggregates in one pass over the wide rows (no self-join),
    then unpivoted to (m1, m2, corr)."""
    wide = wide_months(norm, keys)
    pairs = [(i, j) for i in range(1, 13) for j in range(i, 13)]
    one = wide.agg(*[F.corr(f"m{i}", f"m{j}").alias(f"c_{i}_{j}") for i, j in pairs])
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("m1"), F.lit(j).alias("m2"), F.col(f"c_{i}_{j}").alias("corr"))
        for i, j in pairs])).alias("s")).select("s.*")
    mirrored = stacked.filter(F.col("m1") != F.col("m2")).select(
        F.col("m2").alias("m1"), F.col("m1").alias("m2"), "corr")
    return stacked.unionByName(mirrored)


def lag_corr(norm: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of the 3-month rolling mean ending at month i-1 with month
    i, for i = 4..12, over keys where both exist (L17)."""
    w = Window.partitionBy(*keys).orderBy("month")
    r = rolling3(norm, keys).withColumn("prev3", F.lag("rolling3").over(w))
    ok = r.filter((F.col("month") >= 4) & F.col("prev3").isNotNull() & F.col("norm").isNotNull())
    out = ok.groupBy("month").agg(F.corr("prev3", "norm").alias("corr"), F.count(F.lit(1)).alias("n"))
    return out.withColumn(
        "t_stat", F.when(F.col("n") > 2, F.col("corr")
                         * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("corr") * F.col("corr")))))


def student_t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t for a whole number of degrees of freedom,
    by the finite trigonometric series: with angle a = atan(|t| / sqrt(dof)), the
    mass inside +-t is sin(a) times a sum of even powers of cos(a) for even dof,
    and 2/pi (a + sin(a) times a sum of odd powers) for odd dof."""
    angle = F.atan(F.abs(t) / F.sqrt(dof))
    sin, cos = F.sin(angle), F.cos(angle)
    odd = dof % 2 == 1
    start = F.when(odd, cos).otherwise(F.lit(1.0))
    terms = F.floor((dof - F.when(odd, 3).otherwise(2)) / 2)
    steps = F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    ratio = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
    state = lambda term, total: F.struct(term.alias("term"), total.alias("total"))

    def add(s, j):
        term = s["term"] * cos * cos * ratio(j)
        return state(term, s["total"] + term)
    total = F.aggregate(steps, state(start, start), add, lambda s: s["total"])
    series = F.when(dof == 1, F.lit(0.0)).otherwise(total)
    inside = F.when(odd, 2 / F.pi() * (angle + sin * series)).otherwise(sin * series)
    return F.when((dof >= 1) & t.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))


def _opened(series: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, open_month, first): the first ``n`` months from the opening of the
    series whose months there all exist and are not 0. ``series`` has an array
    ``months`` or is long; arrays need no shuffle, and few series are left."""
    if "months" not in series.columns:
        series = series.groupBy(*keys).agg(F.array(*[
            F.max(F.when(F.col("month") == m, F.col("sales"))) for m in range(1, 13)]).alias("months"))
    active = F.transform("months", lambda v: F.coalesce(v != 0, F.lit(False)))
    s = series.dropna(subset=keys).select(*keys, "months", F.array_position(active, F.lit(True)).cast("int").alias("open_month"))
    s = s.select(*keys, "open_month", F.slice("months", F.greatest("open_month", F.lit(1)), n).alias("first"))
    return s.filter((F.col("open_month") > 0) & (F.size("first") == n)
                    & F.forall("first", lambda v: F.coalesce(v != 0, F.lit(False))))


def opening_features(series: DataFrame, keys: list[str]) -> DataFrame:
    """Opening dynamics over months 1..12 (H8, H9): initial_zeros = months
    before the first non-zero; the first three months from the opening must
    all exist and be non-zero; avg, population std and last-first of them.
    ``series``: long months or ``yearly_sales``."""
    j = _opened(series, keys, 3).select(*keys, "open_month", F.posexplode("first").alias("pos", "sales"))
    return (j.groupBy(*keys, "open_month")
            .agg(F.avg("sales").alias("avg_first3"),
                 F.stddev_pop("sales").alias("vol_first3"),
                 (F.max_by("sales", "pos") - F.min_by("sales", "pos")).alias("growth_first3"))
            .select(*keys, (F.col("open_month") - 1).alias("initial_zeros"), "avg_first3", "vol_first3",
                    "growth_first3"))


def opening_trajectory(series: DataFrame, keys: list[str]) -> DataFrame:
    """First six months from the opening indexed to the first one (H10), only
    for keys with six non-zero months inside the year; keyed by the series.
    ``series``: long months or ``yearly_sales``."""
    j = _opened(series, keys, 6).select(*keys, F.col("first")[0].alias("_base"), F.posexplode("first").alias("_at", "sales"))
    return j.select(*keys, (F.col("_at") + 1).alias("pos"), (F.col("sales") / F.col("_base")).alias("relative_sales"))
