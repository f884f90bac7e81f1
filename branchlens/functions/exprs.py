"""Small Catalyst expression helpers shared by the operators (C8, C10, C11,
K7-K10). Everything stays JVM-side inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_sum(c: Column | str) -> Column:
    """pandas ``sum`` semantics: an all-null group sums to 0, not NULL."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def guarded_ratio(num: Column | str, den: Column | str, default=None, nonzero: bool = False) -> Column:
    """``where(den > 0, num / den, default)`` (or ``den != 0`` when
    ``nonzero``). Never raises under ANSI mode."""
    n, d = col(num), col(den)
    cond = (d != 0) if nonzero else (d > 0)
    dflt = F.lit(default) if default is not None else F.lit(None).cast("double")
    return F.when(cond, n / d).otherwise(dflt)


def log1p_clip0(c: Column | str) -> Column:
    """``log1p(clip(x, lower=0))``; NULL stays NULL."""
    x = col(c)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.log1p(F.greatest(x, F.lit(0.0))))


def clip(c: Column | str, lo=None, hi=None) -> Column:
    """numpy ``clip``: NULL stays NULL (``greatest``/``least`` skip NULLs)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def flag(c: Column | str) -> Column:
    """``(x.fillna(0) > 0).astype(int)``."""
    return (F.coalesce(col(c), F.lit(0.0)) > 0).cast("int")


def finite_or_null(c: Column | str) -> Column:
    """inf / -inf / NaN -> NULL (``replace([inf, -inf], nan)``)."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


# Output rounding shared with the oracle SQL. Money values of the items view
# live on a 1e-4 grid (2-decimal price x 2-decimal discount), so rounding to 4
# decimals never sits on a tie; ratios are rounded to 6.
def rm(c: Column | str) -> Column:
    return F.round(col(c), 4)


# Ratios can land exactly on a rounding tie (a 1e-4-grid sum over an integer
# count); the tiny relative nudge moves exact ties off the boundary so Spark and
# the SQL oracle (same nudge) round them the same way.
RATIO_NUDGE = 1e-12


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(col(c) * F.lit(1.0 + RATIO_NUDGE), digits)


def rounded(df, money=(), ratio=()):
    """Round the named money columns to 4 and ratio columns to 6 decimals,
    keeping column order (output convention shared with the oracle SQL)."""
    money, ratio = set(money), set(ratio)
    cols = []
    for c in df.columns:
        q = F.col(f"`{c}`")
        if c in money:
            cols.append(F.round(q, 4).alias(c))
        elif c in ratio:
            cols.append(r6(q).alias(c))
        else:
            cols.append(q)
    return df.select(*cols)


def extract_count(text: Column | str, default: int = 5, cap: int = 10) -> Column:
    """First stand-alone 1-2 digit number in a request, clamped to 1..cap,
    ``default`` when absent (K19)."""
    m = F.regexp_extract(col(text), r"\b(\d{1,2})\b", 1)
    return F.when(m == "", F.lit(default)).otherwise(F.greatest(F.lit(1), F.least(m.cast("int"), F.lit(cap))))
