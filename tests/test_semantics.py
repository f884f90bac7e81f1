"""FIXTURES §3 frames: months edge cases, null keys, zero denominators, ties."""

from pyspark.sql import functions as F

from branchlens.operators import timeseries as ts
from branchlens.operators.margin import aggregate_margin
from branchlens.operators.nmf import dominant, entropy, group_shares
from branchlens.operators.profiles import success_tiers


def _monthly(spark, rows):
    data = [(k, m + 1, float(v)) for k, vals in rows.items() for m, v in enumerate(vals)]
    return spark.createDataFrame(data, "k string, month int, sales double")


def test_opening_features_edge_cases(spark):
    rows = {
        "lead": [0, 0, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14],     # opens in March
        "zeros": [0] * 12,                                      # never opens
        "gap": [3, 0, 4, 5, 6, 7, 8, 9, 1, 1, 1, 1],          # zero inside the first three
        "late": [0] * 10 + [4, 5],                              # fewer than 3 months left
    }
    f = {r["k"]: r for r in ts.opening_features(_monthly(spark, rows), ["k"]).collect()}
    assert set(f) == {"lead"}
    r = f["lead"]
    assert r["initial_zeros"] == 2 and abs(r["avg_first3"] - 6.0) < 1e-12
    assert abs(r["vol_first3"] - (2 / 3) ** 0.5) < 1e-12 and r["growth_first3"] == 2.0


def test_margin_null_keys_and_zero_sales(spark):
    df = spark.createDataFrame([(None, "A", 10.0, 4.0, 6.0, 1.0), (None, "A", 0.0, 0.0, 0.0, 1.0),
                                ("b", None, 0.0, 1.0, -1.0, 1.0), ("b", None, None, None, None, None)],
                               "branch string, category string, price double, cost double, profit double, qty double")
    g = {(r["branch"], r["category"]): r for r in aggregate_margin(df, ["branch", "category"]).collect()}
    assert g[(None, "A")]["Sales"] == 10.0 and g[(None, "A")]["GM_pct"] == 0.6      # null key kept
    assert g[("b", None)]["Sales"] == 0.0 and g[("b", None)]["GM_pct"] is None      # zero sales guarded


def test_group_shares_and_patterns(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", None, 4.0), ("b", "x", 2.0),
                                (None, "x", 5.0)], "branch string, grp string, price double")
    s = {(r["branch"], r["grp"]): r["rev_share"] for r in group_shares(df).collect()}
    assert s[("a", "x")] == 0.125 and s[("a", None)] == 0.5 and ("b", "x") in s
    assert all(k[0] is not None for k in s)                                          # no branch -> dropped
    w = spark.createDataFrame([("a", "P_1", 0.5), ("a", "P_0", 0.5), ("b", "P_0", 0.0), ("b", "P_1", 1.0)],
                              "branch string, pattern string, weight double")
    d = {r["branch"]: r["Dominant_Pattern"] for r in dominant(w).collect()}
    assert d == {"a": "P_0", "b": "P_1"}                                             # first pattern on ties
    e = {r["branch"]: r["Entropy"] for r in entropy(w).collect()}
    assert abs(e["a"] - 0.6931471805599453) < 1e-12 and e["b"] == 0.0                # 0 log 0 = 0


def test_success_tiers_constant_and_ties(spark):
    prof = spark.createDataFrame([("b", 0, 5.0, 1.0, 0.5), ("b", 1, 5.0, 1.0, 0.5), ("b", 2, 1.0, 0.0, 0.1)],
                                 "branch string, Cluster int, median_sales double, median_profit double, "
                                 "median_margin_pct double")
    t = {r["Cluster"]: r for r in success_tiers(prof, ["branch"]).collect()}
    assert t[0]["SuccessRank"] == 1 and t[1]["SuccessRank"] == 2                     # tie -> cluster order
    assert t[0]["SuccessTier"] == "Tier 1: Most Successful"
    assert t[2]["SuccessTier"] == "Tier 3: Least Successful"
    one = spark.createDataFrame([("c", 0, 5.0, 1.0, 0.5)], prof.schema)
    r = success_tiers(one, ["branch"]).first()
    assert r["SuccessScore"] == 0.0 and r["SuccessRank"] == 1                        # zero variance -> z = 0


def test_student_t_tail(spark):
    """The finite series against numerical integration of the density."""
    import math

    import numpy as np
    cases = [(t, v) for t in (0.0, 0.3, -1.7, 4.0) for v in (1, 2, 3, 4, 7, 30, 171)]
    df = spark.createDataFrame(cases, "t double, v long")
    got = [r[0] for r in df.select(ts.student_t_two_sided_p(F.col("t"), F.col("v"))).collect()]
    for (t, v), p in zip(cases, got):
        x = np.linspace(0, abs(t), 200_001)
        c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        y = c * (1 + x * x / v) ** (-(v + 1) / 2)
        assert abs(p - (1 - 2 * float(np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0])))) < 1e-9
    none = spark.createDataFrame([(None, 3), (1.0, 0)], "t double, v long")
    assert [r[0] for r in none.select(ts.student_t_two_sided_p(F.col("t"), F.col("v"))).collect()] == [None, None]


def test_series_of_every_year(spark):
    rows = [("a", 2000, 3, 5.0), ("a", 2001, 1, 7.0), ("a", 2003, 1, 2.0), ("b", 2001, 12, 1.0)]
    m = ts.monthly_sales(spark.createDataFrame(rows, "branch string, year int, month int, price double"), "branch")
    got = {(r["branch"], r["year"], r["month"]): r["sales"] for r in m.collect()}
    assert len(got) == 4 * 13
    assert got[("a", 2000, 13)] == 7.0 and got[("a", 2001, 13)] is None and got[("b", 2001, 12)] == 1.0
    assert sum(v for (_, _, k), v in got.items() if k <= 12) == 15.0


def test_opening_series_without_joins(spark):
    """Openings of yearly arrays: one shuffle of the kept months, no join, the same
    rows as from long months."""
    import contextlib
    import io

    from pyspark.sql import functions as F
    rows = [(k, 2000, [float(v) for v in s]) for k, s in {
        "a": [0, 5, 6, 7, 8, 9, 10, 0, 0, 0, 0, 0], "b": [0] * 12, "c": [0] * 10 + [3, 4], "d": [1, 0, 2] + [1] * 9,
        "e": [-1, 2, 3] + [0] * 9}.items()] + [(None, 2000, [1.0] * 12)]
    yearly = spark.createDataFrame(rows, "k string, year int, months array<double>")
    long = yearly.select("k", "year", F.posexplode("months").alias("m", "sales")).select("k", "year", (F.col("m") + 1).alias("month"), "sales")
    keys = ["k", "year"]
    feats, tr = ts.opening_features(yearly, keys), ts.opening_trajectory(yearly, keys)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        feats.explain()
        tr.explain()
    assert "Join" not in out.getvalue() and out.getvalue().count("Exchange") == 1
    assert {tuple(r)[:4] for r in feats.collect()} == {("a", 2000, 1, 6.0), ("e", 2000, 0, 4 / 3)}
    assert sorted(feats.collect()) == sorted(ts.opening_features(long, keys).collect())
    assert sorted(map(tuple, tr.collect())) == [("a", 2000, i + 1, (5 + i) / 5) for i in range(6)]
    assert sorted(tr.collect()) == sorted(ts.opening_trajectory(long, keys).collect())


def test_product_rollup_dealt_once(spark):
    """Sums and modes per (branch, product): one shuffle behind the base aggregate,
    no join; ties go to the smallest value, nulls do not count."""
    import contextlib
    import io

    from branchlens.operators import products as pr
    base = spark.createDataFrame(
        [("b", "p", "x", "d1", 2), ("b", "p", "y", "d2", 1), ("b", "p", "y", "d1", 1), ("b", "p", None, None, 9), (None, "p", None, "d", 1)],
        "branch string, Product string, category string, division string, _n long")
    for c in ("Sales", "Cost", "Profit", "Qty", "TABLE", "TAKE AWAY", "Toters"):
        base = base.selectExpr("*", f"CAST(1 AS DOUBLE) AS `{c}`")
    t = pr._rollup(base, ["branch", "Product"])
    with contextlib.redirect_stdout(io.StringIO()) as out:
        t.explain()
    assert "Join" not in out.getvalue() and out.getvalue().count("Exchange") == 1
    assert {(r["branch"], r["Category"], r["Division"], r["Sales"]) for r in t.collect()} == {("b", "x", "d1", 4.0), (None, None, "d", 1.0)}
