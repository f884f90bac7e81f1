"""Ridge regression with cross-validation (L2, L9-L14, L19, L22-L24), one model per
group and penalty, all inside Spark SQL.

A row is (keys..., id, x array<double>, y). Per group one aggregate gives means
and population standard deviations, one the Gram matrix X'X and X'y of the
standardised design. The small systems are solved by Cholesky factorisation
written with higher-order functions on nested arrays, so any number of groups
and penalties is fitted without a driver loop: A = L L', coefficients by one
forward and one backward substitution. Leave-one-out residuals use the exact
closed form e / (1 - h) of a linear smoother (scaling is fitted once on the full
training set, as in the reference), with the leverage h = |L^-1 x|^2 from one
forward substitution per row.

A feature that is constant in a group has z = 0 and coefficient 0, so groups with
different features share one layout: features a group does not use are 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite_or_null
from ..session import cut_lineage


def clean(c: str) -> Column:
    """inf/NaN -> NULL -> 0 (``replace([inf,-inf], nan).fillna(0)``)."""
    return F.coalesce(finite_or_null(F.col(f"`{c}`")), F.lit(0.0))


# ------------------------------------------------- linear algebra on arrays
def _dot(a: str, b: str) -> str:
    """Inner product over the length of ``a``; ``b`` may be longer."""
    return (f"aggregate(zip_with({a}, slice({b}, 1, size({a})), (u_, v_) -> u_ * v_), 0D, (s_, t_) -> s_ + t_)")


def cholesky(a: str) -> Column:
    """Rows of the lower factor of a positive definite matrix."""
    row = (f"aggregate(sequence(0, i_), cast(array() as array<double>), (r_, j_) -> concat(r_, array(if(j_ < i_, "
           f"({a}[i_][j_] - {_dot('r_', 'l_[j_]')}) / l_[j_][j_], sqrt({a}[i_][i_] - {_dot('r_', 'r_')})))))")
    return F.expr(f"aggregate(sequence(0, size({a}) - 1), cast(array() as array<array<double>>), "
                  f"(l_, i_) -> concat(l_, array({row})))")


def forward(l: str, b: str) -> Column:
    """u with L u = b."""
    return F.expr(f"aggregate(sequence(0, size({l}) - 1), cast(array() as array<double>), (w_, k_) -> "
                  f"concat(w_, array(({b}[k_] - {_dot('w_', f'{l}[k_]')}) / {l}[k_][k_])))")


def backward(l: str, u: str) -> Column:
    """x with L' x = u, from the last place to the first."""
    known = f"aggregate(zip_with(w_, slice({l}, k_ + 2, size(w_)), (b_, r_) -> b_ * r_[k_]), 0D, (s_, t_) -> s_ + t_)"
    return F.expr(f"aggregate(reverse(sequence(0, size({l}) - 1)), cast(array() as array<double>), (w_, k_) -> "
                  f"concat(array(({u}[k_] - {known}) / {l}[k_][k_]), w_))")


def inner(a: str, b: str) -> Column:
    return F.expr(_dot(a, b))


# ------------------------------------------------------------------- models
def scalers(rows: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """(keys, mu, sd): mean and population std of each feature; std 0 -> 1 (L2)."""
    st = rows.groupBy(*keys).agg(*[f(F.col("x")[i]).alias(f"_{n}{i}") for i in range(p)
                                   for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return st.select(*keys, F.array(*[F.col(f"_m{i}") for i in range(p)]).alias("mu"),
                     F.array(*[F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0) for i in range(p)]).alias("sd"))


def standardised(rows: DataFrame, scale: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with z = [1, (x - mu) / sd]."""
    z = "concat(array(1D), zip_with(zip_with(x, mu, (a_, b_) -> a_ - b_), sd, (a_, b_) -> a_ / b_))"
    return rows.join(scale, list(keys)).withColumn("z", F.expr(z)).drop("mu", "sd")


def gram(z: DataFrame, keys: Sequence[str], q: int) -> DataFrame:
    """(keys, n, xtx array<array<double>>, xty array<double>): X'X and X'y. One row
    of X'X is one group of the aggregate, which keeps its code small."""
    rows = z.select(*keys, "z", "y", F.posexplode("z").alias("_i", "_v")).groupBy(*keys, "_i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_v") * F.col("y")).alias("_b"),
        *[F.sum(F.col("_v") * F.col("z")[j]).alias(f"_g{j}") for j in range(q)])
    rows = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(
        "_i", F.array(*[F.col(f"_g{j}") for j in range(q)]).alias("g"), F.col("_b").alias("b")))).alias("s"))
    return rows.select(*keys, "n", F.col("s.g").alias("xtx"), F.col("s.b").alias("xty"))


def ridge_models(z: DataFrame, keys: Sequence[str], q: int, alphas: Sequence[float] | Column) -> DataFrame:
    """(keys, alpha, n, l, beta): the factor and coefficients of every group and
    penalty; the intercept is not penalised. ``alphas`` are numbers, or an array
    column over the keys."""
    penalties = alphas if isinstance(alphas, Column) else F.array(*[F.lit(float(a)) for a in alphas])
    m = gram(z, keys, q).withColumn("alpha", F.explode(penalties))
    m = m.withColumn("_a", F.expr("transform(xtx, (r_, i_) -> transform(r_, (v_, j_) -> if(i_ = j_ and i_ > 0, v_ + alpha, v_)))"))
    m = m.withColumn("l", cholesky("_a")).withColumn("_u", forward("l", "xty")).withColumn("beta", backward("l", "_u"))
    return cut_lineage(m.select(*keys, "alpha", "n", "l", "beta"))


def loocv(z: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, alpha, n, loocv_rmse): exact leave-one-out error of every model;
    null with fewer than two rows (L11, L12)."""
    j = z.join(models, list(keys)).withColumn("_w", forward("l", "z"))
    e = F.try_divide(F.col("y") - inner("beta", "z"), 1 - inner("_w", "_w"))
    return (j.groupBy(*keys, "alpha", "n").agg(F.sqrt(F.avg(e * e)).alias("_r"))
            .select(*keys, "alpha", "n", F.when(F.col("n") >= 2, F.col("_r")).alias("loocv_rmse")))


def choose_alpha(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, alpha, loocv_rmse) of the smallest error, smallest alpha on ties;
    the smallest alpha where no error is known (D21f)."""
    order = F.struct(F.col("loocv_rmse").isNull(), "loocv_rmse", "alpha")
    return (scores.groupBy(*keys).agg(F.min_by(F.struct("alpha", "loocv_rmse"), order).alias("s"))
            .select(*keys, "s.alpha", "s.loocv_rmse"))


def fit_ridge_loocv(rows: DataFrame, keys: Sequence[str], p: int, alphas: Sequence[float]):
    """(scalers, models, scores, chosen) of every group. No rows at all is an
    error (D21f)."""
    if not rows.head(1):
        raise ValueError("ridge: no training rows")
    scale = cut_lineage(scalers(rows, keys, p))
    z = standardised(rows, scale, keys)
    models = ridge_models(z, keys, p + 1, alphas)
    scores = cut_lineage(loocv(z, models, keys))
    return scale, models, scores, choose_alpha(scores, keys)


def predict(rows: DataFrame, scale: DataFrame, models: DataFrame, keys: Sequence[str], out: str = "predicted") -> DataFrame:
    """``rows`` (keys, x, ...) with the prediction of each of their group's models."""
    return standardised(rows, scale, keys).join(models, list(keys)).withColumn(out, inner("beta", "z")).drop("z", "l", "beta")


def loo_mean_baseline_rmse(train: DataFrame, target: str) -> Column:
    """LOOCV RMSE of the mean predictor: pred_i = (sum - y_i) / (n - 1) (L19),
    an aggregate over the training rows with the sum as scalar subquery."""
    total = train.select(F.sum(target)).scalar()
    n = train.select(F.count(F.lit(1))).scalar()
    return F.sqrt(F.avg(F.pow(F.col(target) - (total - F.col(target)) / (n - 1), 2)))
